"""Synthetic attack injection as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values (must equal the reference's injector):
SENSOR_ATTACK_SECONDS = 50
SENSOR_ATTACK_TEMP = 60.0
SENSOR_ATTACK_IP = "10.11.12.17"
FLOOD_SECONDS = 50
FLOOD_PPS = 100
FLOOD_SPACING = 0.01
FLOOD_SRC = "198.51.100.44"
FLOOD_DST = "10.11.12.17"
FLOOD_PROTO = "UDP"
FLOOD_SIZE = "60"
FLOOD_INFO = "Mirai UDP Flood"


def inject_sensor(sensor: DataFrame, n: int = SENSOR_ATTACK_SECONDS,
                  value: float = SENSOR_ATTACK_TEMP, ip: str = SENSOR_ATTACK_IP,
                  epoch: str = "epoch") -> DataFrame:
    """Append ``n`` one-second readings of ``value`` after the last sensor time."""
    spark = sensor.sparkSession
    last = F.broadcast(sensor.agg(F.max(epoch).alias("_last")))
    new = (spark.range(1, n + 1).crossJoin(last)
           .select((F.col("_last") + F.col("id")).cast("double").alias(epoch),
                   F.lit(ip).alias("ip"), F.lit(float(value)).alias("temp")))
    return sensor.unionByName(new, allowMissingColumns=True)


def inject_flood(packets: DataFrame, sensor: DataFrame, seconds: int = FLOOD_SECONDS,
                 pps: int = FLOOD_PPS, epoch: str = "epoch") -> DataFrame:
    """Append a flood aligned to the end of the sensor trace.

    Relative time = (last sensor - first sensor) + second + i * 0.01, as
    6-decimal text like the trace files; frame numbers continue.
    """
    spark = packets.sparkSession
    anchors = F.broadcast(sensor.agg((F.max(epoch) - F.min(epoch)).alias("_start"))
                          .crossJoin(packets.agg(F.max("frame").alias("_frame"))))
    n = seconds * pps
    g = spark.range(n).crossJoin(anchors)
    second = (F.floor(F.col("id") / pps) + 1).cast("double")
    i = (F.col("id") % pps).cast("double")
    rel = F.format_string("%.6f", F.col("_start") + second + i * F.lit(FLOOD_SPACING))
    new = g.select((F.col("_frame") + F.col("id") + 1).alias("frame"),
                   rel.cast("double").alias("rel"),
                   F.lit(FLOOD_SRC).alias("src"), F.lit(FLOOD_DST).alias("dst"),
                   F.lit(FLOOD_PROTO).alias("proto"), F.lit(FLOOD_SIZE).alias("size"),
                   F.lit(FLOOD_INFO).alias("info"))
    return packets.unionByName(new, allowMissingColumns=True)
