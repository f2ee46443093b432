"""Exact running aggregates in two levels.

A single ``Window.partitionBy(key).orderBy(t)`` puts a whole key into one
task; a hot key (say a third of all rows) then serialises the job.  Here
rows are first cut into buckets by a monotone coarsening of the order
(time range, hash prefix, score quantile):

1. a window per ``(key, bucket)`` gives the running value inside a bucket;
2. a grouped aggregate per ``(key, bucket)`` gives bucket totals, a tiny
   table whose own running value over buckets is the offset;
3. the offset is joined back on ``(key, bucket)`` (AQE broadcasts it when
   it is small) and combined with the in-bucket value.

The result equals the one-window result exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.session import checkpoint_dir

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def small_side(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """A table of one row per key, ready to join: computed once, and broadcast
    only if it has at most ``limit`` rows (else a plain join)."""
    checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    return F.broadcast(done) if done.count() <= limit else done


def _bucketed(df: DataFrame, keys: Sequence[str], bucket: Column) -> tuple[DataFrame, list[str]]:
    """Adds non-null copies of the keys and the bucket.  Windows partition by
    them and offsets join on them with plain equality, so the join keeps the
    windows' partitioning and the rows are shuffled once."""
    d, cols = df, []
    for i, k in enumerate([*keys, None]):
        c = bucket if k is None else F.col(k)
        d = d.withColumn(f"_k{i}", c)
        kind = d.schema[f"_k{i}"].dataType
        d = d.withColumn(f"_n{i}", c.isNull()).withColumn(f"_k{i}", F.coalesce(F.col(f"_k{i}"), F.lit(0).cast(kind)))
        cols += [f"_n{i}", f"_k{i}"]
    return d, cols


def running_aggregate(df: DataFrame, keys: Sequence[str], order: Sequence, value,
                      out, bucket: Column, how: str = "sum",
                      inclusive: bool = True) -> DataFrame:
    """Add ``out`` = running ``how`` of ``value`` over ``order`` within ``keys``.

    ``value`` / ``out`` may be lists (several running values in one pass).
    ``bucket`` must be non-decreasing in ``order`` within each key.  With
    ``inclusive=False`` the current row is excluded (NULL for the first row
    of a key, like a ``1 PRECEDING`` frame).
    """
    agg = _AGG[how]
    keys = list(keys)
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    outs = list(out) if isinstance(out, (list, tuple)) else [out]
    d = df
    for i, v in enumerate(values):
        d = d.withColumn(f"_rv{i}", _c(v))
    d, cols = _bucketed(d, keys, bucket)
    end = Window.currentRow if inclusive else -1
    w_local = (Window.partitionBy(*cols).orderBy(*[_c(o) for o in order])
               .rowsBetween(Window.unboundedPreceding, end))
    local = d
    for i in range(len(values)):
        local = local.withColumn(f"_loc{i}", agg(f"_rv{i}").over(w_local))

    # bucket totals: a partial/final aggregate over the few columns it needs
    totals = d.groupBy(*cols).agg(*[agg(f"_rv{i}").alias(f"_tot{i}") for i in range(len(values))])
    w_off = (Window.partitionBy(*cols[:-2]).orderBy(*cols[-2:])
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*cols, *[agg(f"_tot{i}").over(w_off).alias(f"_off{i}") for i in range(len(values))])
    joined = local.join(offsets, cols, "left")
    for i, o in enumerate(outs):
        off, loc = F.col(f"_off{i}"), F.col(f"_loc{i}")
        if how == "sum":
            combined = F.coalesce(off, F.lit(0)) + F.coalesce(loc, F.lit(0))
            if not inclusive:
                combined = F.when(off.isNull() & loc.isNull(), F.lit(None)).otherwise(combined)
        elif how == "max":
            combined = F.greatest(off, loc)
        else:
            combined = F.least(off, loc)
        joined = joined.withColumn(o, combined)
    drop = list(cols)
    for i in range(len(values)):
        drop += [f"_rv{i}", f"_loc{i}", f"_off{i}"]
    return joined.drop(*drop)


#: rows aimed at in one range of ``range_running``
RANGE_ROWS = 50_000


def range_running(df: DataFrame, keys: Sequence[str], order: Sequence, value, out, rows: int | None = None,
                  ranges: int | None = None, inclusive: bool = True) -> DataFrame:
    """Running sums of ``value`` over ``order`` within ``keys`` as ``out`` (lists
    for several), by range partitions.

    Rows are dealt to sorted ranges of ``(keys, order)``, as many as the data
    need (``rows`` is their number, counted if not given), and written once.  A
    range's running sums start from the totals of the ranges before it, one row
    per key and range, so neither a hot key nor the number of distinct values
    makes one task larger.  Rows with equal ``(keys, order)`` share a range.
    Without ``inclusive`` the row itself is left out and a key's first row has
    null.
    """
    keys, order = list(keys), [_c(o) for o in order]
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    outs = list(out) if isinstance(out, (list, tuple)) else [out]
    checkpoint_dir(df.sparkSession)
    n = ranges or 1 + (df.count() if rows is None else rows) // RANGE_ROWS
    dealt = df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()) \
        .checkpoint(eager=True)
    d, cols = _bucketed(dealt, keys, F.col("_range"))
    totals = d.groupBy(*cols).agg(*[F.sum(_c(v)).alias(f"_tot{i}") for i, v in enumerate(values)])
    back = Window.partitionBy(*cols[:-2]).orderBy(*cols[-2:]).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*cols, *[F.sum(f"_tot{i}").over(back).alias(f"_off{i}") for i in range(len(values))])
    inside = Window.partitionBy(*cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = d.withColumns({f"_loc{i}": F.sum(_c(v)).over(inside) for i, v in enumerate(values)})
    joined = local.join(small_side(before), cols, "left")
    for i, o in enumerate(outs):
        off, loc = F.col(f"_off{i}"), F.col(f"_loc{i}")
        both = F.coalesce(off, F.lit(0)) + F.coalesce(loc, F.lit(0))
        joined = joined.withColumn(o, both if inclusive else F.when(off.isNotNull() | loc.isNotNull(), both))
    return joined.drop("_range", *cols, *[f"_{x}{i}" for i in range(len(values)) for x in ("loc", "off")])


def sorted_rank(df: DataFrame, bounds: str, x, out: str, n_bounds: int,
                inclusive: bool = False) -> DataFrame:
    """``out`` = number of entries of the ascending array column ``bounds``
    (length ``n_bounds``) that are < ``x`` (<= with ``inclusive``): a binary
    search written as one projection per halving step (``element_at`` keeps
    it in generated code; Catalyst does not fold the steps together because
    each reuses the last)."""
    step = 1
    while step * 2 <= n_bounds:
        step *= 2
    d = df.withColumn(out, F.lit(0))
    xv = _c(x)
    while step >= 1:
        nxt = F.col(out) + F.lit(step)
        probe = F.element_at(F.col(bounds), nxt)
        ok = (nxt <= F.lit(n_bounds)) & ((probe <= xv) if inclusive else (probe < xv))
        d = d.withColumn(out, F.when(ok, nxt).otherwise(F.col(out)))
        step //= 2
    return d


def quantile_bucket(df: DataFrame, keys: Sequence[str], col: str, buckets: int = 256,
                    accuracy: int | None = None) -> DataFrame:
    """Attach ``_qb``: a monotone bucket of ``col`` per key from approximate
    quantiles of the key's values (one small row per key, joined back).

    Buckets only balance work (results are exact whatever the bounds), so
    the sketch needs a rank error well below one bucket, not more.
    """
    keys = list(keys)
    accuracy = accuracy or max(1000, 8 * buckets)
    probs = [i / buckets for i in range(1, buckets)]
    bounds = df.groupBy(*keys).agg(
        F.percentile_approx(col, probs, accuracy).alias("_bounds"))
    if keys:
        joined = df.join(small_side(bounds), keys, "left")
    else:
        joined = df.crossJoin(F.broadcast(bounds))
    return sorted_rank(joined, "_bounds", col, "_qb", len(probs)).drop("_bounds")


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, k: int,
                    salt_buckets: int = 64, salt_col=None) -> DataFrame:
    """First ``k`` rows per key by ``order``, in two levels.

    Level 1 keeps the first ``k`` of each (key, salt) slice, so a hot key is
    spread over ``salt_buckets`` tasks; level 2 ranks at most
    ``k * salt_buckets`` candidates per key.  Adds ``rn`` (1..k).
    """
    keys = list(keys)
    order_c = [_c(o) for o in order]
    salt = _c(salt_col) if salt_col is not None else F.xxhash64(*order_c)
    d = df.withColumn("_salt", F.pmod(salt, F.lit(salt_buckets)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order_c)
    cand = d.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*keys).orderBy(*order_c)
    return (cand.withColumn("rn", F.row_number().over(w2).cast("bigint")).where(F.col("rn") <= k)
            .drop("_salt", "_r1"))


def two_level_lag(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, out: str,
                  bucket: Column) -> DataFrame:
    """``out`` = ``value`` of the previous row in ``order`` within ``keys``
    (NULL for a key's first row), computed per (key, bucket) slice; the
    first row of a slice takes the last value of the nearest earlier
    non-empty slice from a small per-slice table."""
    order_c = [_c(o) for o in order]
    d, cols = _bucketed(df, list(keys), bucket)
    w = Window.partitionBy(*cols).orderBy(*order_c)
    last = d.groupBy(*cols).agg(F.max_by(value, F.struct(*order_c)).alias("_last"))
    wp = Window.partitionBy(*cols[:-2]).orderBy(*cols[-2:])
    prev = last.select(*cols, F.lag("_last").over(wp).alias("_prev_slice"))
    d = d.withColumn("_lag", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    j = d.join(prev, cols, "left")
    res = j.withColumn(out, F.when(F.col("_first"), F.col("_prev_slice")).otherwise(F.col("_lag")))
    return res.drop("_lag", "_first", "_prev_slice", *cols)
