"""Metric-sample operators over a long table ``(metric, <labels>, ts, seq, value)``:
publication, instant and range queries, resampling, ratios, mappings and
bands (S8, W4-W8, J2, P12, P14-P16, P21)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.scalar import band, map_values, percent
from flowsentry.operators.prefix import two_level_lag

# Fixed values (must equal the reference's dashboard and agent):
# gauge names published per flow window
WINDOW_GAUGES = {
    "flow_count": "iot_cyber_flow_count",
    "avg_duration": "iot_cyber_avg_flow_duration_sec",
    "avg_bytes": "iot_cyber_avg_flow_bytes",
    "label": "iot_cyber_attack_label",
}
# attack-type value mapping
ATTACK_TYPE_TEXT = {0: "Benign", 1: "Mirai/DDoS", 2: "BruteForce"}
# absolute threshold bands (first step is the base)
BANDS_PERCENT = [(None, "green"), (80.0, "red")]
BANDS_ATTACK = [(None, "green"), (1.0, "red")]
BANDS_CO2 = [(None, "green"), (1000.0, "#EAB839"), (2000.0, "red")]
# static target labels of the agent scrape job
AGENT_TARGET_LABELS = {"job": "iot-universal-agent", "instance": "ubi-secure-node-01:8000",
                       "device_group": "residential-beta"}

SERIES = ("metric", "device")


def to_metric_samples(windows: DataFrame, ts: str, gauges: Mapping[str, str] = WINDOW_GAUGES,
                      labels: Sequence[str] = ()) -> DataFrame:
    """Wide per-window rows -> one gauge sample per (window, metric)."""
    cols = list(gauges)
    casted = windows.select(*labels, F.col(ts).cast("double").alias("ts"),
                            *[F.col(c).cast("double").alias(c) for c in cols])
    long = casted.unpivot([*labels, "ts"], cols, "feature", "value")
    return long.select(map_values("feature", gauges).alias("metric"), *labels, "ts", "value")


def with_labels(df: DataFrame, labels: Mapping[str, str] = AGENT_TARGET_LABELS) -> DataFrame:
    """Attach static target labels as literal columns."""
    out = df
    for k, v in labels.items():
        out = out.withColumn(k, F.lit(v))
    return out


def latest(metrics: DataFrame, at, series: Sequence[str] = SERIES) -> DataFrame:
    """Instant query: last non-null sample at or before ``at`` per series.

    ``at`` is a number or a one-row DataFrame with column ``at``.  max_by is
    a partial aggregate, so a hot series is combined before the shuffle.
    """
    m = metrics.where(F.col("value").isNotNull())
    if isinstance(at, DataFrame):
        m = m.crossJoin(F.broadcast(at.select("at"))).where(F.col("ts") <= F.col("at")).drop("at")
    else:
        m = m.where(F.col("ts") <= F.lit(float(at)))
    key = F.struct("ts", "seq") if "seq" in metrics.columns else F.col("ts")
    return m.groupBy(*series).agg(F.max_by("value", key).alias("value"),
                                  F.max("ts").alias("ts"))


def latest_or_zero(metrics: DataFrame, at, wanted: Sequence[str],
                   labels: Sequence[str] = ("device",)) -> DataFrame:
    """Latest value of each wanted metric for every label set seen in the
    data; a wanted metric without a sample reads 0.0.

    The grid is (distinct label sets) x (wanted list, a parameter), so it
    grows only with the number of series.
    """
    labels = list(labels)
    spark = metrics.sparkSession
    want = F.broadcast(spark.createDataFrame([(w,) for w in wanted], "metric string"))
    series = metrics.select(*labels).distinct()
    grid = series.crossJoin(want)
    lat = latest(metrics, at, ["metric", *labels])
    return grid.join(lat, ["metric", *labels], "left").select(
        *labels, "metric", F.coalesce(F.col("value"), F.lit(0.0)).alias("value"))


def gauge_state(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Last-write-wins gauge per label set (``order`` gives write order)."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def counter_deltas(metrics: DataFrame, slice_s: float, series: Sequence[str] = SERIES) -> DataFrame:
    """Reset-aware step of every counter sample: ``v - prev``, ``v`` after a
    reset (``v < prev``), 0 for the first sample of a series.

    The previous sample comes from a two-level lag over time slices, so a hot
    series is spread over many tasks and no step is lost at a slice edge.
    """
    order = ["ts", "seq"] if "seq" in metrics.columns else ["ts"]
    d = two_level_lag(metrics, series, order, "value", "_prev",
                      F.floor(F.col("ts") / F.lit(float(slice_s))).cast("bigint"))
    delta = F.when(F.col("_prev").isNull(), F.lit(0.0)) \
             .when(F.col("value") < F.col("_prev"), F.col("value")) \
             .otherwise(F.col("value") - F.col("_prev"))
    return d.withColumn("delta", delta).drop("_prev")


def counter_increase(metrics: DataFrame, range_s: float, series: Sequence[str] = SERIES,
                     per_second: bool = False, slice_s: float | None = None) -> DataFrame:
    """``increase`` (or ``rate``) over aligned ranges ``[b*range, (b+1)*range)``:
    the sum of the steps of the samples in the range.  A step belongs to its
    later sample, so the ranges of a series add up to its whole increase.  No
    boundary extrapolation.
    """
    r = float(range_s)
    d = counter_deltas(metrics, slice_s or max(1.0, r), series)
    b = F.floor(F.col("ts") / F.lit(r)).cast("bigint").alias("_b")
    g = d.groupBy(*series, b).agg(F.sum("delta").alias("increase"))
    out = g.select(*series, (F.col("_b") * F.lit(r)).alias("range_start"), "increase")
    if per_second:
        out = out.withColumn("rate", F.col("increase") / F.lit(r)).drop("increase")
    return out


def counter_sliding(metrics: DataFrame, range_s: float, series: Sequence[str] = SERIES,
                    per_second: bool = False) -> DataFrame:
    """Range query at every sample: the sum of the steps of the samples in
    ``[ts - range, ts]``, as ``increase`` or ``rate``.

    Every sample also goes to the next time slice (a slice is one range long),
    so the frame runs inside one (series, slice) and a hot series is spread
    over its slices.  Times compare in microseconds.
    """
    us = F.round(F.col("ts") * F.lit(1e6)).cast("bigint")
    r = int(round(float(range_s) * 1e6))
    d = counter_deltas(metrics, range_s, series).withColumn("_us", us)
    slice_ = F.floor(F.col("_us") / F.lit(r)).cast("bigint")
    both = d.withColumn("_own", slice_).withColumn(
        "_slice", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy(*series, "_slice").orderBy("_us").rangeBetween(-r, Window.currentRow)
    out = both.withColumn("increase", F.sum("delta").over(w)).where(F.col("_own") == F.col("_slice"))
    out = out.drop("_us", "_own", "_slice", "delta")
    if per_second:
        out = out.withColumn("rate", F.col("increase") / F.lit(float(range_s))).drop("increase")
    return out


def resample_last(metrics: DataFrame, step: float, series: Sequence[str] = SERIES) -> DataFrame:
    """Scrape resample: last value per series and ``step``-second tick; the
    sample is stamped at the tick end (the scrape instant)."""
    b = F.floor(F.col("ts") / F.lit(float(step))).cast("bigint")
    key = F.struct("ts", "seq") if "seq" in metrics.columns else F.col("ts")
    g = metrics.groupBy(*series, b.alias("_b")).agg(F.max_by("value", key).alias("value"))
    return g.select(*series, ((F.col("_b") + 1) * F.lit(float(step))).alias("ts"), "value")


def lookback(df: DataFrame, range_s: float, ts: str = "ts") -> DataFrame:
    """Rows within ``range_s`` seconds of the newest sample (anchor = one-row max)."""
    anchor = F.broadcast(df.agg(F.max(ts).alias("_now")))
    return df.crossJoin(anchor).where(F.col(ts) > F.col("_now") - F.lit(float(range_s))).drop("_now")


def metric_ratio(metrics: DataFrame, num: str, den: str, keys: Sequence[str],
                 out: str = "pct") -> DataFrame:
    """Vector match of two metrics on ``keys``: 100 * num / den.

    One conditional aggregate grouped on the match keys (no self-join).
    """
    m = metrics.where(F.col("metric").isin(num, den))
    g = m.groupBy(*keys).agg(
        F.max(F.when(F.col("metric") == num, F.col("value"))).alias("_a"),
        F.max(F.when(F.col("metric") == den, F.col("value"))).alias("_b"))
    return g.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).select(
        *keys, percent("_a", "_b").alias(out))


def attack_type_text(col: str = "value"):
    return map_values(F.col(col).cast("int"), ATTACK_TYPE_TEXT)


def bands(col: str, steps) -> "F.Column":
    return band(col, steps)
