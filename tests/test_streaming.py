import pandas as pd
from pyspark.sql import functions as F

from flowsentry.operators.alerts import time_to_alert
from flowsentry.session import scratch_path
from flowsentry.streaming.align import OUT_SCHEMA, assemble_ticks, late_rows, stream_align
from flowsentry.streaming.alert import alert_sink, read_alerts, stream_time_to_alert
from flowsentry.streaming.runner import rows_dropped_by_watermark, run_available_now, run_foreach_batch
from flowsentry.streaming.windows import stream_counts, stream_windows
from flowsentry.operators.cleaning import clean_flows, rebase
from flowsentry.operators.windows import agent_windows

RAW = "ts double, duration string, src_bytes string, dst_bytes string, label int"
SC = "device string, ts double, label int, pred int, flow_count long, avg_duration double, avg_bytes double"


def test_stream_windows_equal_batch(spark):
    rows = [(1000.0 + i * 3.7, str(i % 4), str(i), "-", int(i % 9 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, RAW)
    src = scratch_path(spark, "t-flows")
    df.write.parquet(f"{src}/p=0")
    spark.createDataFrame([(5000.0, "0", "0", "0", 0)], RAW).write.parquet(f"{src}/p=1")
    stream = spark.readStream.schema(df.schema).parquet(f"{src}/p=*")
    got = run_available_now(spark, stream_windows(stream, 1000.0, 10, 0), "t-sw").toPandas()
    exp = agent_windows(rebase(clean_flows(df)), 10).toPandas()
    key = ["window"]
    m = got.sort_values(key).reset_index(drop=True)
    e = exp.sort_values(key).reset_index(drop=True)
    assert len(m) == len(e)
    pd.testing.assert_frame_equal(m[e.columns], e, check_dtype=False)


def test_alert_negative_and_once(spark):
    rows = [("d", 0.0, 0, 1, 5, 1.0, 1.0), ("d", 10.0, 1, 0, 5, 1.0, 1.0), ("d", 20.0, 1, 1, 5, 1.0, 1.0),
            ("e", 0.0, 0, 1, 0, 0.0, 0.0), ("e", 10.0, 1, 0, 5, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SC)
    b = {r.device: r for r in time_to_alert(df, by=["device"]).collect()}
    assert b["d"].time_to_alert_seconds == -10.0            # false positive came first
    assert b["e"].time_to_alert_seconds is None             # all-zero window is not scored
    # one row per micro-batch: the alert is written once, other batches write no folder
    src = scratch_path(spark, "t-alert")
    df.coalesce(1).write.option("maxRecordsPerFile", 1).parquet(src)
    sink = scratch_path(spark, "t-alert-sink")
    assert read_alerts(spark, sink).count() == 0
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    run_foreach_batch(stream_time_to_alert(stream), alert_sink(sink), scratch_path(spark, "t-alert-ck"), "update")
    got = read_alerts(spark, sink).collect()
    assert [(r.device, r.time_to_alert_seconds) for r in got] == [("d", -10.0)]
    assert spark.read.option("basePath", sink).json(f"{sink}/batch_id=*").select("batch_id").distinct().count() == 1


def _align(spark, batches, watermark_s, bucket_s=2.0):
    schema = "site string, kind int, t double"
    src, out, ck = (scratch_path(spark, f"t-align-{x}") for x in ("in", "out", "ck"))
    for i, rows in enumerate([*batches, [("end", 2, 1e6)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/part={i:03d}")
        stream = spark.readStream.schema(schema).parquet(f"{src}/part=*")
        q = (stream_align(stream, bucket_s, watermark_s).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        assert rows_dropped_by_watermark(q) == 0
    parts = spark.read.schema(OUT_SCHEMA).parquet(out)
    late = sum(r.n_packets for r in late_rows(parts).collect())
    return {(r.site, r.tick): r.n_packets for r in assemble_ticks(parts).collect()}, late


def test_align_over_mixed_batches_equals_one_batch(spark):
    import random
    r = random.Random(9)
    ticks = sorted({round(r.uniform(0, 40), 1) for _ in range(25)})
    ev = [(s, 0, t) for s in "ab" for t in ticks] + [(r.choice("ab"), 1, round(r.uniform(0, 42), 2)) for _ in range(300)]
    want = {}
    for s in "ab":
        for lo, hi in zip([-1.0, *ticks], ticks[:-1]):
            want[(s, hi)] = sum(1 for q, k, t in ev if q == s and k == 1 and lo < t <= hi)
    r.shuffle(ev)
    got, dropped = _align(spark, [ev[:110], ev[110:200], ev[200:]], 100.0)
    assert got == want and dropped == 0


def test_align_keeps_packets_of_later_batches(spark):
    one = [("s", 0, 1.0), ("s", 0, 2.0), ("s", 0, 3.0)]
    two = [("s", 1, 0.5), ("s", 1, 1.5), ("s", 1, 2.5), ("s", 0, 4.0)]
    assert _align(spark, [one, two], 10.0)[0] == {("s", 1.0): 1, ("s", 2.0): 1, ("s", 3.0): 1}
    # later than the watermark allows: not counted, but put out as late
    got, dropped = _align(spark, [[*one, ("s", 0, 50.0)], [("s", 1, 0.5), ("s", 0, 51.0)]], 0.0)
    assert got[("s", 1.0)] == 0 and dropped == 1


def test_sub_second_windows(spark):
    rows = [(100.0 + i * 0.3, "1", "1", "1", 0) for i in range(60)]
    df = spark.createDataFrame(rows, RAW)
    src = scratch_path(spark, "t-sub")
    df.write.parquet(f"{src}/p=0")
    spark.createDataFrame([(500.0, "0", "0", "0", 0)], RAW).write.parquet(f"{src}/p=1")
    stream = spark.readStream.schema(df.schema).parquet(f"{src}/p=*")
    for size in (2.5, 0.5):
        got = run_available_now(spark, stream_windows(stream, 100.0, size, 0.0), "t-sub").collect()
        exp = agent_windows(rebase(clean_flows(df)), size).collect()
        assert sorted((r.window, r.flow_count) for r in got) == sorted((r.window, r.flow_count) for r in exp)


def test_stream_align_and_counts(spark):
    ev = [("s", 0, 1.0), ("s", 0, 2.0), ("s", 0, 3.0), ("s", 1, 0.2), ("s", 1, 1.0), ("s", 1, 1.5),
          ("s", 1, 3.2), ("s", 1, 2.5)]
    assert _align(spark, [ev], 0.0)[0] == {("s", 1.0): 2, ("s", 2.0): 1}
    pk = spark.createDataFrame([("UDP",), ("UDP",), ("TCP",)], "proto string")
    psrc = scratch_path(spark, "t-pk")
    pk.write.parquet(psrc)
    q = (stream_counts(spark.readStream.schema(pk.schema).parquet(psrc)).writeStream
         .format("memory").queryName("t_counts").outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()
    assert {r.proto: r.packets_total for r in spark.table("t_counts").collect()} == {"UDP": 2, "TCP": 1}


def test_late_rows_are_counted(spark):
    schema = "ts double, duration string, src_bytes string, dst_bytes string, label int"
    src = scratch_path(spark, "t-late")
    out, ck = scratch_path(spark, "t-late-out"), scratch_path(spark, "t-late-ck")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{src}/p=*")
        q = (stream_windows(stream, 0.0, 10, 0).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        return q

    spark.createDataFrame([(0.0, "1", "1", "1", 0), (100.0, "1", "1", "1", 0)], schema) \
        .write.parquet(f"{src}/p=0")
    assert rows_dropped_by_watermark(run()) == 0
    # same query restarted: the watermark (100 s) survives in the checkpoint,
    # so a row at 5 s is late and dropped -- and counted
    spark.createDataFrame([(5.0, "1", "1", "1", 1)], schema).write.parquet(f"{src}/p=1")
    assert rows_dropped_by_watermark(run()) == 1
    assert {r.window for r in spark.read.parquet(out).collect()} == {0}


def test_align_state_calls_follow_blocks_not_rows():
    """State is read and written once per block of grid points and batch."""
    import random
    from flowsentry.streaming import align

    class Map(dict):
        calls = 0

        def getValue(self, k):
            Map.calls += 1
            return self.get(k)

        def updateValue(self, k, v):
            Map.calls += 1
            self[k] = v

        def iterator(self):
            return iter(self.items())

    class Handle:
        def getMapState(self, *_):
            return Map()

        def registerTimer(self, at):
            pass

    class Timer:
        def getCurrentWatermarkInMs(self):
            return 0
    r = random.Random(5)
    a = align._Aligner(3600.0)
    a.init(Handle())
    events = []
    for _ in range(2):
        rows = [(0, c, float(c)) for c in r.sample(range(3600), 500)] + [(1, c, c - 0.5) for c in r.choices(range(3600), k=3000)]
        events += rows
        df = pd.DataFrame(rows, columns=["kind", "cell", "t"])
        assert list(a.handleInputRows(("s", 0), iter([df[:700], df[700:]]), Timer())) == []
    assert Map.calls <= 2 * 2 * 2 * (3600 // align.BLOCK + 1)
    (out,) = a.handleExpiredTimer(("s", 0), Timer(), None)
    ticks = sorted({t for k, _, t in events if k == 0})
    packets = [c for k, c, _ in events if k == 1]
    want = [sum(lo < c <= hi for c in packets) for lo, hi in zip([-1.0, *ticks], ticks)]
    assert out["n_packets"].tolist() == [*want, sum(c > ticks[-1] for c in packets)]
    assert out["tick"].tolist()[:-1] == ticks and out["tick"].isna().tolist()[-1]
