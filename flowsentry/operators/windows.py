"""Tumbling-window features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.scalar import window_id

FEATURES = ("flow_count", "avg_duration", "avg_bytes")


def with_window(df: DataFrame, size: float, ts: str = "ts", out: str = "window") -> DataFrame:
    return df.withColumn(out, window_id(ts, size))


def window_features(flows: DataFrame, size: float) -> DataFrame:
    """Offline windows: only valid flows (duration > 0) count; a window with
    no valid flow does not exist; label = max over the valid flows.

    Input: cleaned, rebased flows.  One hash aggregate (partial + final), so
    a hot window is combined map-side before the shuffle.
    """
    valid = flows.where(F.col("duration") > 0)
    g = valid.groupBy(window_id("ts", size).alias("window")).agg(
        F.count("duration").alias("flow_count"),
        F.avg("duration").alias("avg_duration"),
        F.sum("src_bytes").alias("src_bytes"),
        F.sum("dst_bytes").alias("dst_bytes"),
        F.max("label").alias("label"),
    )
    g = g.withColumn("avg_bytes", (F.col("src_bytes") + F.col("dst_bytes")) / F.col("flow_count"))
    return g.na.drop(how="any").select(
        "window", "flow_count", "avg_duration", "src_bytes", "dst_bytes", "avg_bytes", "label")


def agent_windows(flows: DataFrame, size: float) -> DataFrame:
    """Live-agent windows: every window holding any flow; features over the
    valid flows, zero when there is none; label = max over all flows."""
    v = F.col("duration") > 0
    n = F.count_if(v)
    g = flows.groupBy(window_id("ts", size).alias("window")).agg(
        n.alias("flow_count"),
        F.avg(F.when(v, F.col("duration"))).alias("_avg_d"),
        F.sum(F.when(v, F.col("src_bytes") + F.col("dst_bytes"))).alias("_bytes"),
        F.max("label").alias("label"),
    )
    return g.select(
        "window",
        F.col("flow_count").cast("bigint").alias("flow_count"),
        F.coalesce(F.col("_avg_d"), F.lit(0.0)).alias("avg_duration"),
        F.when(F.col("flow_count") > 0, F.col("_bytes") / F.col("flow_count"))
         .otherwise(F.lit(0.0)).alias("avg_bytes"),
        F.col("label").cast("int").alias("label"),
    )


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def window_ids(df: DataFrame, col: str = "window") -> DataFrame:
    """Distinct window ids (sorted only at the sink by the caller)."""
    return df.select(col).distinct()


def from_window(df: DataFrame, start: int, col: str = "window") -> DataFrame:
    """Replay from ``start``; an empty result stays empty."""
    return df.where(F.col(col) >= start)
