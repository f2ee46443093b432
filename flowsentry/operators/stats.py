"""Measurement statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.operators.prefix import range_running, small_side, sorted_rank


def _stack(df: DataFrame, metrics: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Turn one row of ``<metric>_<field>`` columns into one row per metric."""
    parts = []
    for m in metrics:
        parts.append(F.struct(F.lit(m).alias("metric"),
                              *[F.col(f"{m}_{f}").alias(f) for f in fields]))
    return df.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def stats_by_class(df: DataFrame, cols: Sequence[str] = ("cpu", "ram", "latency"),
                   label: str = "label") -> DataFrame:
    """Per metric: mean / population std / n for baseline (0) and attack (1);
    a missing class gives 0.0.  One aggregate pass, no per-class shuffle."""
    aggs = []
    for c in cols:
        for cls, tag in ((0, "baseline"), (1, "attack")):
            v = F.when(F.col(label) == cls, F.col(c).cast("double"))
            aggs += [F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{c}_{tag}_mean"),
                     F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias(f"{c}_{tag}_std"),
                     F.count(v).alias(f"{c}_{tag}_n")]
    one = df.agg(*aggs)
    return _stack(one, cols, ["baseline_mean", "baseline_std", "baseline_n",
                              "attack_mean", "attack_std", "attack_n"])


def stats_overall(df: DataFrame, cols: Sequence[str] = ("cpu", "ram", "latency")) -> DataFrame:
    """Per metric: mean, sample std, max, min."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}_mean"), F.stddev_samp(x).alias(f"{c}_std"),
                 F.max(x).alias(f"{c}_max"), F.min(x).alias(f"{c}_min")]
    return _stack(df.agg(*aggs), cols, ["mean", "std", "max", "min"])


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                    accuracy: int = 100000) -> DataFrame:
    """Exact linear-interpolation quantiles without gathering the column.

    1. ``percentile_approx`` gives, per key, a value band around each target
       rank.  Its rank error is at most n / accuracy (and one rank), so a band
       of 3n / accuracy ranks and at least three on either side holds the
       answer; the sketch is asked for bands of doubling width and each key
       takes the first that is wide enough for its n;
    2. in one pass every row emits one histogram entry (how many band floors
       it reaches, for the "rows below the band" counts) plus one entry per
       band that contains it -- about one row out per row in, no join with
       the target list;
    3. band values are grouped (ties collapse, so a hot value is one row),
       ranked by a running count over ranges of the band, and the two order
       statistics around ``p * (n - 1)`` are interpolated.

    Returns one row per key with ``q0, q1, ...`` (same order as ``probs``).
    """
    by = list(by)
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    ps = [float(probs[i]) for i in order]
    n_t = len(ps)
    x = F.col(col).cast("double")
    d = df.where(x.isNotNull()).select(*by, x.alias("_x"))
    eps, steps = 3.0 / accuracy, 1
    while eps * 2 ** (steps - 1) < 1:
        steps += 1
    wide = [eps * 2 ** i for i in range(steps)]
    stats = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_x", [max(0.0, p - e) for p in ps for e in wide], accuracy).alias("_lo"),
        F.percentile_approx("_x", [min(1.0, p + e) for p in ps for e in wide], accuracy).alias("_hi"))
    step = F.least(F.lit(steps - 1), F.greatest(F.lit(0), F.ceil(F.log2(F.lit(3.0 / eps) / F.col("_n"))))).cast("int")
    pick = lambda c: F.array(*[F.element_at(c, step + 1 + t * steps) for t in range(n_t)]).alias(c)
    st = stats.select(*by, "_n", pick("_lo"), pick("_hi"))
    # one row per key
    j = d.join(small_side(st), by) if by else d.crossJoin(F.broadcast(st))
    j = sorted_rank(j, "_lo", F.col("_x"), "_reach", n_t, inclusive=True)
    entry = "struct<k:int,i:int,v:double>"
    hist = F.struct(F.lit(0).alias("k"), F.col("_reach").cast("int").alias("i"),
                    F.lit(None).cast("double").alias("v")).cast(entry)
    bands = [F.when((F.col("_x") >= F.element_at("_lo", t + 1)) & (F.col("_x") <= F.element_at("_hi", t + 1)),
                    F.struct(F.lit(1).alias("k"), F.lit(t).alias("i"), F.col("_x").alias("v")).cast(entry))
             for t in range(n_t)]
    e = j.select(*by, F.explode(F.array_compact(F.array(hist, *bands))).alias("_e"))
    # small (band values + P+1 histogram slots per key) and read by two
    # branches: materialise it once instead of re-scanning the input
    g = e.groupBy(*by, "_e.k", "_e.i", "_e.v").agg(F.count(F.lit(1)).alias("_c")).checkpoint(eager=True)
    # rows below band t reach at most t floors: below_t = sum of hist[r], r <= t
    # (every row has exactly one histogram entry, so their sum is n)
    below = g.where(F.col("k") == 0).groupBy(*by).agg(
        F.sum("_c").alias("_n"),
        *[F.sum(F.when(F.col("i") <= t, F.col("_c")).otherwise(F.lit(0))).alias(f"_b{t}")
          for t in range(n_t)])
    band = range_running(g.where(F.col("k") == 1), [*by, "i"], ["v"], "_c", "_cum")
    band = band.join(small_side(below), by) if by else band.crossJoin(F.broadcast(below))
    below_t = F.lit(0)
    for t in range(n_t):
        below_t = F.when(F.col("i") == t, F.col(f"_b{t}")).otherwise(below_t)
    p_t = F.lit(0.0)
    for t in range(n_t):
        p_t = F.when(F.col("i") == t, F.lit(ps[t])).otherwise(p_t)
    h = p_t * (F.col("_n") - 1)
    b = band.withColumn("_end", below_t + F.col("_cum")) \
            .withColumn("_r0", F.floor(h)).withColumn("_frac", h - F.floor(h))
    # value at 0-based rank r is the first band value whose rank end > r
    v = b.groupBy(*by, "i").agg(
        F.min_by("v", F.when(F.col("_end") > F.col("_r0"), F.col("v"))).alias("_v0"),
        F.min_by("v", F.when(F.col("_end") > F.col("_r0") + 1, F.col("v"))).alias("_v1"),
        F.first("_frac").alias("_frac"))
    v = v.withColumn("_q", F.when(F.col("_frac") == 0, F.col("_v0")).otherwise(
        F.col("_v0") + F.col("_frac") * (F.coalesce(F.col("_v1"), F.col("_v0")) - F.col("_v0"))))
    out = v.groupBy(*by).agg(*[F.max(F.when(F.col("i") == order.index(i), F.col("_q"))).alias(f"q{i}")
                               for i in range(n_t)])
    return out


def trimmed_stats(df: DataFrame, col: str, p: float = 0.99, exact: bool = True,
                  digits: int = 4, accuracy: int = 100000) -> DataFrame:
    """Cut at the p-quantile (linear interpolation), keep values <= cut, then
    n / mean / population std / p-quantile of the kept values, rounded.

    ``exact=True`` uses ``exact_quantiles`` (bounded memory, exact result);
    ``exact=False`` uses ``percentile_approx`` directly.
    """
    x = F.col(col).cast("double")
    if exact:
        cut = F.broadcast(exact_quantiles(df, col, [p], accuracy=accuracy)
                          .select(F.col("q0").alias("_cut")))
    else:
        cut = F.broadcast(df.agg(F.percentile_approx(x, F.lit(p), accuracy).alias("_cut")))
    kept = df.crossJoin(cut).where(x <= F.col("_cut")).select(x.alias("_v"))
    g = kept.agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))
    if exact:
        pq = exact_quantiles(kept, "_v", [p], accuracy=accuracy).select(F.col("q0").alias("p"))
    else:
        pq = kept.agg(F.percentile_approx("_v", F.lit(p), accuracy).alias("p"))
    g = g.crossJoin(pq)
    return g.select("n", *[F.round(c, digits).alias(c) for c in ("mean", "std")],
                    F.round("p", digits).alias(f"p{int(round(p * 100))}"))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed), every bin
    reported, empty ones with 0.  A constant column spans [v-0.5, v+0.5]."""
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    rng = F.broadcast(rng.select(
        F.when(F.col("_mx") > F.col("_mn"), F.col("_mn")).otherwise(F.col("_mn") - 0.5).alias("_lo"),
        F.when(F.col("_mx") > F.col("_mn"), F.col("_mx")).otherwise(F.col("_mx") + 0.5).alias("_hi")))
    b = F.least(F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins),
                F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).crossJoin(rng).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    allb = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(rng)
    width = (F.col("_hi") - F.col("_lo")) / bins
    return allb.join(counts, "bin", "left").select(
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("lo"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def device_profile(df: DataFrame, limit_mb: float = 2048.0, cpu: str = "cpu_pct",
                   mem: str = "mem_mb") -> DataFrame:
    """Samples, CPU mean/max, memory mean/max and peak memory as % of the limit."""
    g = df.agg(F.count(F.lit(1)).alias("n"),
               F.avg(cpu).alias("cpu_mean"), F.max(cpu).alias("cpu_max"),
               F.avg(mem).alias("mem_mean"), F.max(mem).alias("mem_max"))
    return g.withColumn("mem_peak_pct", F.lit(100.0) * F.col("mem_max") / F.lit(float(limit_mb)))


def time_to_first_attack(df: DataFrame, warmup: float = 60.0, ts: str = "ts",
                         label: str = "label") -> DataFrame:
    """First attack time minus the warm-up (NULL when there is no attack)."""
    return df.agg((F.min(F.when(F.col(label) == 1, F.col(ts))) - F.lit(float(warmup)))
                  .alias("time_to_first_attack"))


# ----------------------------------------------------------------------------
# mergeable sketches
# ----------------------------------------------------------------------------

SKETCH_K = 400
#: rank error of a merged sketch of ``SKETCH_K`` (share of the rows)
SKETCH_ERROR = 0.01


def daily_sketches(df: DataFrame, col: str, ts: str = "ts", by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """One row per key and UTC day: ``day, n, sketch`` (a KLL sketch of a few
    kilobytes).  Days are sketched once, stored, and merged later, so a quantile
    of any span of days needs no look at the rows again.  Null values are left
    out, a day without any has no row."""
    x = F.col(col).cast("double")
    day = F.floor(F.col(ts) / 86400).cast("bigint")
    return df.where(x.isNotNull()).groupBy(*by, day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(x, k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``n, q0, q1, ...`` per key of merged sketches, within ``SKETCH_ERROR`` in rank."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(f"q{i}")
                                     for i, p in enumerate(probs)])
