"""Registered queries: Structured Streaming parity runs.

Each query lands its input as files under the checkpoint folder, runs the
streaming plan with ``availableNow`` into a parquet sink and returns the
sink as a DataFrame, so the stream's answer is checked like a batch one.
A far-future sentinel flow closes the last real window under the watermark.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.operators import alignment as AL
from flowsentry.operators import baselines as BL
from flowsentry.operators import forest as FR
from flowsentry.operators import windows as WN
from flowsentry.operators.alerts import time_to_alert
from flowsentry.plans.catalog import query
from flowsentry.plans.common import (
    D_FC, D_SPLIT, D_THR, D_WF, W, duck, flows_clean, train_test,
)
from flowsentry.session import scratch_path
from flowsentry.sources import bindings as B
from flowsentry.streaming.align import assemble_ticks, late_rows, stream_align
from flowsentry.streaming.alert import alert_sink, read_alerts, stream_time_to_alert
from flowsentry.streaming.committed import CommittedTable
from flowsentry.streaming.live import GAUGE_SCHEMA, start_live_detector
from flowsentry.streaming.runner import run_available_now, run_complete_snapshot, run_foreach_batch, sliced, state_partitions
from flowsentry.streaming.score import stream_score
from flowsentry.streaming.windows import stream_counts, stream_windows

_AW = ("aw", f"""SELECT cast(floor(ts / {W}) as bigint) AS "window",
    cast(count(*) FILTER (WHERE duration > 0) as bigint) AS flow_count,
    coalesce(avg(duration) FILTER (WHERE duration > 0), 0.0) AS avg_duration,
    CASE WHEN count(*) FILTER (WHERE duration > 0) > 0
         THEN sum(src_bytes + dst_bytes) FILTER (WHERE duration > 0) / count(*) FILTER (WHERE duration > 0)
         ELSE 0.0 END AS avg_bytes,
    max(label) AS label FROM fc GROUP BY 1""")


def _flow_stream(spark, sf):
    """Flows landed as parquet plus a sentinel; returns (stream, t0)."""
    raw = B.flows(spark, sf)
    stats = raw.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")).first()
    src = scratch_path(spark, "flow-stream")
    raw.write.mode("overwrite").parquet(f"{src}/part=data")
    values = {"event_id": -1, "ts": float(stats["t1"]) + 3 * W, "label": 0}
    row = tuple(values.get(c, "0") for c in raw.columns)
    spark.createDataFrame([row], raw.schema).write.mode("overwrite").parquet(f"{src}/part=sentinel")
    stream = spark.readStream.schema(raw.schema).parquet(f"{src}/part=*")
    return stream, float(stats["t0"])


def _stream_windows(spark, sf):
    stream, t0 = _flow_stream(spark, sf)
    return run_available_now(spark, stream_windows(stream, t0, W, 0.0), "stream-windows")


@query("stream_windows", duck(["flows"], D_FC, _AW, select="SELECT * FROM aw"), ["avg_duration", "avg_bytes"])
def q_stream_windows(spark, sf):
    """Live agent windows (watermarked tumbling windows) equal the batch A2."""
    return _stream_windows(spark, sf)


_SCORED = """SELECT "window", label, flow_count, avg_duration, avg_bytes, true AS probability_in_range,
    true AS pred_follows_probability FROM aw WHERE NOT (flow_count = 0 AND avg_duration = 0 AND avg_bytes = 0)"""


@query("stream_score", duck(["flows"], D_FC, _AW, select=_SCORED), ["avg_duration", "avg_bytes"])
def q_stream_score(spark, sf):
    """The window stream scored by the forest fitted on the training split."""
    train, _ = train_test(spark, sf)
    model = FR.fit_forest(train)
    stream, t0 = _flow_stream(spark, sf)
    scored = stream_score(stream_windows(stream, t0, W, 0.0), model)
    p = F.col("attack_probability")
    return run_available_now(spark, scored, "stream-score").select(
        "window", "label", "flow_count", "avg_duration", "avg_bytes", p.between(0.0, 1.0).alias("probability_in_range"),
        ((F.col("pred") == 1) == (p > 0.5)).alias("pred_follows_probability"))


_TTA = """SELECT {cols}first_attack_label_ts, first_detection_ts,
    first_detection_ts - first_attack_label_ts AS time_to_alert_seconds
    FROM (SELECT min(ts) FILTER (WHERE label = 1) AS first_attack_label_ts,
                 min(ts) FILTER (WHERE pred = 1 AND NOT (flow_count = 0 AND avg_duration = 0 AND avg_bytes = 0)) AS first_detection_ts
          FROM (SELECT aw.*, "window" * {w} AS ts, cast(flow_count > threshold as int) AS pred FROM aw, thr) s) g"""
_TTA_COLS = ["first_attack_label_ts", "first_detection_ts", "time_to_alert_seconds"]


@query("time_to_alert", duck(["flows"], D_FC, D_WF, *D_SPLIT, D_THR, _AW, select=_TTA.format(cols="", w=W)), _TTA_COLS)
def q_time_to_alert(spark, sf):
    """T3 (batch): threshold detector over agent windows; first label, first
    detection, and the delay between them."""
    train, _ = train_test(spark, sf)
    aw = WN.agent_windows(flows_clean(spark, sf), W).withColumn("ts", F.col("window") * F.lit(W))
    scored = aw.crossJoin(F.broadcast(BL.sigma_threshold(train).select("threshold"))) \
               .withColumn("pred", (F.col("flow_count") > F.col("threshold")).cast("int"))
    return time_to_alert(scored)


@query("stream_time_to_alert", duck(["flows"], D_FC, D_WF, *D_SPLIT, D_THR, _AW,
                                    select=_TTA.format(cols="'agent' AS device, ", w=W)), _TTA_COLS)
def q_stream_tta(spark, sf):
    """T3 + S9: the same alert from a stream, written once."""
    train, _ = train_test(spark, sf)
    thr = float(BL.sigma_threshold(train).first()["threshold"])
    stream, t0 = _flow_stream(spark, sf)
    # stage 1: the window job lands closed windows; stage 2 streams them into
    # the alert aggregate (one query holds one stateful aggregation)
    landed = scratch_path(spark, "window-sink")
    first = run_available_now(spark, stream_windows(stream, t0, W, 0.0), "stream-windows", landed)
    w = spark.readStream.schema(first.schema).parquet(landed)
    scored = w.select("*", (F.col("window") * F.lit(W)).alias("ts"),
                      (F.col("flow_count") > F.lit(thr)).cast("int").alias("pred"),
                      F.lit("agent").alias("device"))
    out = scratch_path(spark, "alerts")
    run_foreach_batch(stream_time_to_alert(scored), alert_sink(out), scratch_path(spark, "alerts-checkpoint"), "update")
    return read_alerts(spark, out)


ALIGN_BUCKET_S, ALIGN_DELAY_S, ALIGN_SLICES = 3600.0, 6 * 3600.0, 6


@query("stream_align", duck(["ticks", "packets"],
        ("tk", "SELECT DISTINCT epoch AS tick FROM ticks"),
        ("iv", "SELECT tick, lag(tick) OVER (ORDER BY tick) AS prev, max(tick) OVER () AS last FROM tk"),
        ("pa", """SELECT frame, rel + (SELECT min(epoch) FROM ticks) AS t, dst FROM packets
                  WHERE try_cast(size AS DOUBLE) IS NOT NULL AND rel IS NOT NULL"""),
        ("pl", """SELECT *, CASE WHEN frame % 2 = 0 THEN 'even' ELSE 'odd' END AS site,
                    frame % 97 = 0 AND t < (SELECT min(tick) + (max(tick) - min(tick)) / 2 FROM tk) AS late FROM pa"""),
        ("pk", "SELECT * FROM pl WHERE NOT late"),
        # ticks fall on whole seconds, so every site sees all of them
        select="""SELECT s.site, iv.tick, count(pk.frame) AS n_packets, false AS late
                  FROM iv CROSS JOIN (SELECT unnest(['even', 'odd']) AS site) s
                  LEFT JOIN pk ON pk.t <= iv.tick AND (iv.prev IS NULL OR pk.t > iv.prev) AND s.site = pk.site
                  WHERE iv.tick < iv.last GROUP BY s.site, iv.tick
                  UNION ALL SELECT site, floor(t / 3600) * 3600.0, count(*), true FROM pl WHERE late GROUP BY ALL"""), ["tick"])
def q_stream_align(spark, sf):
    """Ticks and packets of two sites as one stream of several
    micro-batches, aligned by state per site and hour.

    Rows come in slices of the whole time, up to four hours out of order, under
    a watermark of six hours, so that most buckets are flushed while the stream
    goes on from its checkpoint.  One packet in 97 of the first half comes with the last slice only:
    too late, and reported per site and bucket (with the bucket's start)."""
    tk = B.ticks(spark, sf)
    good, _ = AL.parse_packets(B.packets(spark, sf))
    t0 = tk.agg(F.min("epoch").alias("t0"))
    pk = AL.translate(good, "rel_s", t0, "t")
    span = tk.agg(F.min("epoch"), F.max("epoch")).first()
    low, width = float(span[0]), float(span[1] - span[0])
    site = F.when(F.col("frame") % 2 == 0, "even").otherwise("odd")
    at_tick, at = F.col("epoch"), F.col("t") + (F.col("frame") % 5) * 3600.0
    late = (F.col("frame") % 97 == 0) & (F.col("t") < low + width / 2)
    nth = lambda x: F.least(F.lit(ALIGN_SLICES - 1), F.greatest(
        F.lit(0), F.floor((x - low) * ALIGN_SLICES / width).cast("int")))
    ev = tk.select(F.explode(F.array(F.lit("even"), F.lit("odd"))).alias("site"), F.lit(0).alias("kind"),
                   at_tick.alias("t"), nth(at_tick).alias("slice")) \
        .unionByName(pk.select(site.alias("site"), F.lit(1).alias("kind"), "t",
                               F.when(late, ALIGN_SLICES - 1).otherwise(nth(at)).alias("slice")))
    ev = sliced(spark, ev, "slice", "align-slices")
    src, out, ck = (scratch_path(spark, f"align-{x}") for x in ("stream", "out", "checkpoint"))
    cols = "site string, kind int, t double"
    # a row far beyond closes every bucket
    end = spark.createDataFrame([("end", 2, low + width + 10 * ALIGN_DELAY_S)], cols).coalesce(1)
    with state_partitions(spark, spark.sparkContext.defaultParallelism):
        for i in range(ALIGN_SLICES + 1):  # each lands in files of several tasks and is drained as one micro-batch
            (end if i == ALIGN_SLICES else ev.where(F.col("slice") == i).drop("slice")).write.parquet(f"{src}/part={i}")
            stream = spark.readStream.schema(cols).parquet(f"{src}/part=*")
            parts = run_available_now(spark, stream_align(stream, ALIGN_BUCKET_S, ALIGN_DELAY_S, resolution_s=1.0),
                                      "stream-align", out, ck)
    gone = late_rows(parts).select("site", (F.col("bucket") * ALIGN_BUCKET_S).alias("tick"), "n_packets", F.lit(True).alias("late"))
    return assemble_ticks(parts).withColumn("late", F.lit(False)).unionByName(gone)


@query("stream_protocol_counts", duck(["packets"], select="""SELECT proto, count(*) AS packets_total
    FROM packets WHERE try_cast(size AS DOUBLE) IS NOT NULL AND rel IS NOT NULL GROUP BY proto"""))
def q_stream_protocol_counts(spark, sf):
    """Running packet counter per protocol over a packet stream
    (complete mode; the final snapshot holds the totals)."""
    good, _ = AL.parse_packets(B.packets(spark, sf))
    src = scratch_path(spark, "packet-stream")
    good.select("frame", "proto").write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema("frame long, proto string").option("maxFilesPerTrigger", 2).parquet(src)
    return run_complete_snapshot(spark, stream_counts(stream), "protocol-counter")


@query("live_gauges", duck(["flows"], D_FC, _AW, select=f"""SELECT m.metric, "window" * {W} AS ts, true AS value_in_range
    FROM aw, (SELECT unnest(['ai_anomaly_score', 'ai_attack_probability']) AS metric) m
    WHERE NOT (flow_count = 0 AND avg_duration = 0 AND avg_bytes = 0)"""), ["ts"])
def q_live_gauges(spark, sf):
    """T4 + T5 + S8: the live path (windows, forest, gauges) drained once; the
    published prediction and probability samples."""
    train, _ = train_test(spark, sf)
    model = FR.fit_forest(train)
    stream, t0 = _flow_stream(spark, sf)
    out = scratch_path(spark, "live-gauges")
    start_live_detector(stream, model, t0, W, out, scratch_path(spark, "live-checkpoint"), 0.0,
                        available_now=True, committed=True).awaitTermination()
    value = F.col("value")
    return CommittedTable(spark, out, GAUGE_SCHEMA).read().select(
        "metric", "ts", F.when(F.col("metric") == "ai_anomaly_score", value.isin(0.0, 1.0)).otherwise(
            value.between(0.0, 1.0)).alias("value_in_range"))
