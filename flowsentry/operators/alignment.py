"""Packet-to-sensor-tick alignment and trace counters.

``align_forward`` is a forward as-of join: each packet goes to the smallest
sensor tick at or after its time.  It is planned as a union of the two
traces plus windows, never as a range/nested-loop join:

* a running ``min`` of tick times over descending time, per time bucket and
  part, gives each packet the next tick in its bucket;
* one row per bucket gives the first tick after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.scalar import numeric
from flowsentry.operators.cleaning import parse_or_reject
from flowsentry.operators.prefix import running_aggregate, sorted_rank

# ticks of a time bucket; most buckets (rows of the broadcast next-tick table)
# and most parts of one bucket
TICKS_PER_BUCKET, MAX_BUCKETS, MAX_SPREAD = 2000, 4096, 1024


def translate(df: DataFrame, rel: str, t0: DataFrame, out: str = "t") -> DataFrame:
    """Relative -> absolute time: ``rel + t0`` (t0 is a one-row frame ``t0``)."""
    return df.crossJoin(F.broadcast(t0.select("t0"))) \
             .withColumn(out, F.col(rel) + F.col("t0")).drop("t0")


def sensor_ticks(sensor: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Distinct tick times of parseable sensor rows."""
    return sensor.where(F.col(epoch).isNotNull()).select(F.col(epoch).alias("tick")).distinct()


def parse_packets(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed packets and rejects: bad time or bad size never count.  Only plain
    decimal numbers parse (no ``60d``, no ``NaN``, no infinity)."""
    return parse_or_reject(packets, {"rel_s": numeric("rel"), "size_b": numeric("size")})


def align_forward(packets: DataFrame, ticks: DataFrame, t: str = "t",
                  drop_tail: bool = True, buckets: int | None = None,
                  spread: int | None = None) -> DataFrame:
    """Attach ``tick`` = smallest tick >= packet time.

    ``ticks`` has one column ``tick`` (distinct).  With ``drop_tail`` the
    last tick is never flushed, so packets after the second-to-last tick
    are dropped; packets after the last tick are always dropped.

    Plan: time buckets come from quantiles of the ticks (about
    ``TICKS_PER_BUCKET`` each).  Inside a bucket a running ``min`` of tick
    times over descending time gives the next tick; packets of a bucket are
    dealt to ``spread`` parts and its ticks are copied to each, so a burst,
    even one equal timestamp, is no single task.  Past a bucket's last tick the
    next bucket's first tick applies: one row per bucket, broadcast.  Packets
    are scanned once and shuffled once.
    """
    cols = packets.columns
    n = ticks.count()
    if not n:
        return packets.withColumn("tick", F.lit(None).cast("double")).limit(0)
    buckets = buckets or min(MAX_BUCKETS, -(-n // TICKS_PER_BUCKET))
    parts = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = spread or max(1, min(MAX_SPREAD, 2 * parts // buckets))
    at = ticks.select(F.col("tick").cast("double").alias("_at"))
    probs = [i / buckets for i in range(1, buckets)]
    bounds = F.broadcast(at.agg(F.percentile_approx("_at", probs, 8 * buckets).alias("_bounds"))) if probs else None

    def bucketed(df):
        if bounds is None:
            return df.withColumn("_qb", F.lit(0))
        return sorted_rank(df.crossJoin(bounds), "_bounds", "_at", "_qb", len(probs)).drop("_bounds")

    p = bucketed(packets.withColumn("_at", F.col(t).cast("double")))
    p = p.withColumn("_part", F.pmod(F.xxhash64(*cols), F.lit(spread)).cast("int")) \
         .withColumn("_kind", F.lit(1)).withColumn("_tick", F.lit(None).cast("double"))
    k = bucketed(at)
    copies = k.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))) \
              .withColumn("_kind", F.lit(0)).withColumn("_tick", F.col("_at"))
    u = p.unionByName(copies, allowMissingColumns=True)
    w = Window.partitionBy("_qb", "_part").orderBy(F.col("_at").desc(), "_kind") \
              .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = u.withColumn("tick", F.min("_tick").over(w)).where("_kind = 1")
    firsts = k.groupBy("_qb").agg(F.min("_at").alias("_first"))
    later = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # at most MAX_BUCKETS + 1 rows: every bucket with the first tick after it
    after = F.broadcast(packets.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_b"))
                        .join(firsts, F.col("_b") == F.col("_qb"), "left").drop("_qb")
                        .withColumn("_next", F.min("_first").over(later)).select("_b", "_next"))
    res = inside.join(after, F.col("_qb") == F.col("_b"), "left") \
                .withColumn("tick", F.coalesce("tick", "_next")).where(F.col("tick").isNotNull()).select(*cols, "tick")
    if drop_tail:
        last = F.broadcast(ticks.agg(F.max("tick").alias("_last")))
        res = res.crossJoin(last).where(F.col("tick") < F.col("_last")).drop("_last")
    return res


def packets_per_tick(aligned: DataFrame, ticks: DataFrame, drop_tail: bool = True) -> DataFrame:
    """Packets counted per tick, ticks without packets included with 0.

    With ``drop_tail`` the last tick (never flushed) is not reported.
    """
    counts = aligned.groupBy("tick").agg(F.count(F.lit(1)).alias("n_packets"))
    t = ticks.select("tick")
    if drop_tail:
        last = F.broadcast(ticks.agg(F.max("tick").alias("_last")))
        t = t.crossJoin(last).where(F.col("tick") < F.col("_last")).drop("_last")
    return t.join(counts, "tick", "left").select(
        "tick", F.coalesce(F.col("n_packets"), F.lit(0)).cast("bigint").alias("n_packets"))


def protocol_counts(packets: DataFrame, proto: str = "proto") -> DataFrame:
    return packets.groupBy(proto).agg(F.count(F.lit(1)).alias("n_packets"))


def protocol_running(packets: DataFrame, t: str = "t", proto: str = "proto",
                     frame: str = "frame", bucket_s: float = 3600.0) -> DataFrame:
    """Cumulative packet counter per protocol in time order (two-level)."""
    d = packets.withColumn("_one", F.lit(1))
    r = running_aggregate(d, keys=[proto], order=[t, frame], value="_one", out="packets_total",
                          bucket=F.floor(F.col(t) / F.lit(float(bucket_s))))
    return r.drop("_one")
