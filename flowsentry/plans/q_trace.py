"""Registered queries: sensor/packet traces, alignment, injection (S2, S3,
J1, A15, A16, P18, P19, G1, G2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.operators import alignment as AL
from flowsentry.operators import inject as IN
from flowsentry.operators.metrics import gauge_state
from flowsentry.plans.catalog import query
from flowsentry.plans.common import duck
from flowsentry.session import scratch_path
from flowsentry.sources import bindings as B
from flowsentry.sources.files import (
    read_packets, read_sensor, write_packets_csv, write_sensor_csv,
)

_IV = [
    ("tk", "SELECT DISTINCT epoch AS tick FROM ticks"),
    ("iv", "SELECT tick, lag(tick) OVER (ORDER BY tick) AS prev, max(tick) OVER () AS last FROM tk"),
    ("pk", """SELECT frame, rel + (SELECT min(epoch) FROM ticks) AS t, src, dst, proto, size
              FROM packets WHERE try_cast(size AS DOUBLE) IS NOT NULL AND rel IS NOT NULL"""),
    ("al", """SELECT pk.*, iv.tick FROM pk JOIN iv ON pk.t <= iv.tick AND (iv.prev IS NULL OR pk.t > iv.prev)
              WHERE iv.tick < iv.last"""),
]


def _aligned(spark, sf):
    """Aligned packets and the distinct ticks.  The tick table (one row per
    distinct sensor second) is read by the union, the tail cut and the
    per-tick report, so it is materialised once."""
    tk = B.ticks(spark, sf)
    ticks = AL.sensor_ticks(tk).checkpoint(eager=True)
    good, _ = AL.parse_packets(B.packets(spark, sf))
    t0 = ticks.agg(F.min("tick").alias("t0"))
    pk = AL.translate(good, "rel_s", t0, "t").select("frame", "t", "src", "dst", "proto", "size")
    return AL.align_forward(pk, ticks, "t", drop_tail=True), ticks


@query("scan_sensor", duck(["ticks"], select="SELECT epoch, ip, temp FROM ticks"), ["epoch", "temp"])
def q_scan_sensor(spark, sf):
    """27-column positional sensor CSV, read back by position."""
    path = scratch_path(spark, "sensor")
    write_sensor_csv(B.ticks(spark, sf), path)
    return read_sensor(spark, path)


@query("scan_packets", duck(["packets"], select="SELECT * FROM packets"), ["rel"])
def q_scan_packets(spark, sf):
    """S3: 7-column packet CSV, read back by position."""
    path = scratch_path(spark, "packets")
    write_packets_csv(B.packets(spark, sf), path)
    return read_packets(spark, path).withColumn("rel", F.col("rel").try_cast("double"))


# edge rows among the real ones: Java-only spellings and a NaN time
_ODD_SIZE = "CASE WHEN dst = '10.1.0.1' THEN '60d' ELSE size END"
_ODD_TIME = "CASE WHEN dst = '10.1.0.2' THEN 'NaN' ELSE cast(rel as {text}) END"


@query("rejects", duck(["packets"], select="""SELECT frame, CASE WHEN dst = '10.1.0.2' THEN 'rel_s' ELSE 'size_b' END
    AS reject_reason FROM packets WHERE size = 'bad' OR dst IN ('10.1.0.1', '10.1.0.2')"""))
def q_rejects(spark, sf):
    """Packets whose time or size does not parse are set aside, not counted."""
    p = B.packets(spark, sf)
    p = p.withColumn("size", F.expr(_ODD_SIZE)).withColumn("rel", F.expr(_ODD_TIME.format(text="string")))
    _, bad = AL.parse_packets(p)
    return bad.select("frame", "reject_reason")


@query("align_packets", duck(["ticks", "packets"], *_IV, select="SELECT * FROM al"), ["t", "tick"])
def q_align(spark, sf):
    """Each packet to the smallest sensor tick >= its time; last tick never flushed."""
    al, _ = _aligned(spark, sf)
    return al


@query("packets_per_tick", duck(["ticks", "packets"], *_IV, select="""SELECT iv.tick, count(pk.frame) AS n_packets
    FROM iv LEFT JOIN pk ON pk.t <= iv.tick AND (iv.prev IS NULL OR pk.t > iv.prev)
    WHERE iv.tick < iv.last GROUP BY iv.tick"""), ["tick"])
def q_per_tick(spark, sf):
    """Packets flushed per tick, zero ticks included."""
    al, ticks = _aligned(spark, sf)
    return AL.packets_per_tick(al, ticks)


@query("protocol_counts", duck(["ticks", "packets"], *_IV, select="""SELECT proto, count(*) AS n_packets
    FROM al GROUP BY proto"""))
def q_proto(spark, sf):
    """Packet counter per protocol (flushed, valid-size packets)."""
    al, _ = _aligned(spark, sf)
    return AL.protocol_counts(al)


@query("inject_sensor", duck(["ticks"], select="""SELECT epoch, ip, temp FROM ticks UNION ALL
    SELECT (SELECT max(epoch) FROM ticks) + i, '10.11.12.17', 60.0::DOUBLE FROM generate_series(1, 50) t(i)"""),
       ["epoch", "temp"])
def q_inject_sensor(spark, sf):
    """G1: 50 s of 60 degC appended after the last sensor reading."""
    return IN.inject_sensor(B.ticks(spark, sf).select("epoch", "ip", "temp"))


@query("inject_flood", duck(["ticks", "packets"],
        ("an", "SELECT (SELECT max(epoch) - min(epoch) FROM ticks) AS st, (SELECT max(frame) FROM packets) AS fr"),
        select="""SELECT frame, rel, src, dst, proto, size, info FROM packets UNION ALL
    SELECT fr + i + 1, cast(printf('%.6f', st + cast(i // 100 + 1 as double) + cast(i % 100 as double) * 0.01::DOUBLE) as double),
      '198.51.100.44', '10.11.12.17', 'UDP', '60', 'Mirai UDP Flood' FROM an, generate_series(0, 4999) t(i)"""),
       ["rel"])
def q_inject_flood(spark, sf):
    """100 packets/s for 50 s aligned to the sensor end, frames continued."""
    return IN.inject_flood(B.packets(spark, sf), B.ticks(spark, sf))


@query("protocol_running", duck(["ticks", "packets"], ("pk", """SELECT frame, proto,
        rel + (SELECT min(epoch) FROM ticks) AS t FROM packets
        WHERE try_cast(size AS DOUBLE) IS NOT NULL AND rel IS NOT NULL"""),
        select="""SELECT frame, proto, t, count(*) OVER (PARTITION BY proto ORDER BY t, frame
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS packets_total FROM pk"""), ["t"])
def q_proto_running(spark, sf):
    """Running packet counter per protocol in time order."""
    good, _ = AL.parse_packets(B.packets(spark, sf))
    t0 = B.ticks(spark, sf).agg(F.min("epoch").alias("t0"))
    pk = AL.translate(good, "rel_s", t0, "t").select("frame", "proto", "t")
    return AL.protocol_running(pk).withColumn("packets_total", F.col("packets_total").cast("bigint"))


@query("byte_gauge", duck(["packets"], select="""SELECT proto, src, dst, bytes FROM (
    SELECT proto, src, dst, cast(size as double) AS bytes,
      row_number() OVER (PARTITION BY proto, src, dst ORDER BY rel DESC, frame DESC) AS rn
    FROM packets WHERE size <> 'bad') r WHERE rn = 1"""), ["bytes"])
def q_byte_gauge(spark, sf):
    """Last packet size per (protocol, source, destination)."""
    good, _ = AL.parse_packets(B.packets(spark, sf))
    return gauge_state(good.withColumnRenamed("size_b", "bytes"), ["proto", "src", "dst"], "bytes", ["rel_s", "frame"])
