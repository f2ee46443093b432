"""Live tumbling windows and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.operators.cleaning import clean_flows

# Fixed value: the live detector polls every 5 s.
POLL_TRIGGER = "5 seconds"


def event_time(flows: DataFrame, t0: float, ts: str = "ts") -> DataFrame:
    """Event time on the rebased timeline (a live stream cannot know the
    global minimum, so the origin ``t0`` is explicit)."""
    return flows.withColumn("et", F.timestamp_seconds(F.col(ts) - F.lit(float(t0))))


def stream_windows(raw_flows: DataFrame, t0: float, size_s: float, watermark_s: float) -> DataFrame:
    """Agent windows over a flow stream: valid-flow features (0 when none),
    label over all flows; a window is emitted once the watermark passes.

    ``size_s`` may be any number of microseconds.  ``watermark_s`` is how late
    a flow may come after the newest one; later flows of closed windows are
    dropped and counted (``runner.rows_dropped_by_watermark``)."""
    us = int(round(size_s * 1e6))
    f = event_time(clean_flows(raw_flows), t0).withWatermark("et", f"{int(round(watermark_s * 1e6))} microseconds")
    v = F.col("duration") > 0
    g = f.groupBy(F.window("et", f"{us} microseconds").alias("w")).agg(
        F.count_if(v).alias("flow_count"),
        F.avg(F.when(v, F.col("duration"))).alias("_avg_d"),
        F.sum(F.when(v, F.col("src_bytes") + F.col("dst_bytes"))).alias("_bytes"),
        F.max("label").alias("label"))
    return g.select(
        F.floor(F.unix_micros(F.col("w.start")) / F.lit(us)).cast("bigint").alias("window"),
        F.col("flow_count").cast("bigint").alias("flow_count"),
        F.coalesce(F.col("_avg_d"), F.lit(0.0)).alias("avg_duration"),
        F.when(F.col("flow_count") > 0, F.col("_bytes") / F.col("flow_count"))
         .otherwise(F.lit(0.0)).alias("avg_bytes"),
        F.col("label").cast("int").alias("label"))


def stream_counts(packets: DataFrame, proto: str = "proto") -> DataFrame:
    """Running packet counter per protocol (update / complete mode)."""
    return packets.groupBy(proto).agg(F.count(F.lit(1)).alias("packets_total"))
