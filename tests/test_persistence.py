import pandas as pd
from pyspark.sql import functions as F

from flowsentry.operators.forest import fit_forest, load_detector, save_detector, score_forest
from flowsentry.operators.isolation import IsolationForest, load_isolation, save_isolation
from flowsentry.session import scratch_path
from flowsentry.streaming.live import start_live_detector

RAW = "ts double, duration string, src_bytes string, dst_bytes string, label int"


def _windows(spark):
    rows = [(float(i), 0, float(i % 5), float(i % 7), int(i % 11 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "window double, x long, avg_duration double, avg_bytes double, label int")
    return df.select(F.col("window").cast("bigint").alias("window"),
                     (F.col("window") % 13 + F.col("label") * 20).cast("long").alias("flow_count"),
                     "avg_duration", "avg_bytes", "label")


def test_forest_roundtrip(spark):
    w = _windows(spark)
    model = fit_forest(w, trees=10)
    path = scratch_path(spark, "t-rf")
    save_detector(model, path, {"n_train": 300, "features": ["flow_count", "avg_duration", "avg_bytes"]})
    back, meta = load_detector(path)
    a = score_forest(model, w).orderBy("id").toPandas()
    b = score_forest(back, w).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert meta["n_train"] == 300


def test_isolation_roundtrip(spark):
    w = _windows(spark)
    m = IsolationForest(trees=20).fit(w)
    path = scratch_path(spark, "t-if")
    save_isolation(m, path)
    back = load_isolation(spark, path)
    a = m.decide(m.score(w)).orderBy("window").toPandas()
    b = back.decide(back.score(w)).orderBy("window").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_live_path_publishes_gauges(spark):
    w = _windows(spark)
    model = fit_forest(w, trees=5)
    rows = [(i * 2.0, str(1 + i % 3), "10", "5", int(i % 50 == 0)) for i in range(400)]
    src = scratch_path(spark, "t-live-in")
    spark.createDataFrame(rows, RAW).write.parquet(src)
    out = scratch_path(spark, "t-live-out")
    q = start_live_detector(spark.readStream.schema(RAW).parquet(src), model, 0.0, 100.0, out,
                            scratch_path(spark, "t-live-ck"), 0.0, available_now=True)
    q.awaitTermination()
    from flowsentry.streaming.score import latency_samples
    lat = latency_samples(q).collect()
    assert lat and all(r.value > 0 and r.ts > 1.7e9 for r in lat)
    got = spark.read.parquet(out)
    names = {r.metric for r in got.select("metric").distinct().collect()}
    assert names == {"ai_anomaly_score", "ai_attack_probability"}
    # 8 windows of 100 s; the last one stays open under the watermark
    assert got.where("metric = 'ai_anomaly_score'").count() == 7


def test_scored_rows_are_evaluated_once(spark):
    """The gauge sink reads every scored row once, though it writes two gauges."""
    from flowsentry.streaming.score import publisher
    seen = spark.sparkContext.accumulator(0)

    def touch(rows):
        for pdf in rows:
            seen.add(len(pdf))
            yield pdf
    df = spark.range(10).selectExpr("id as window", "0 as pred", "0.5D as attack_probability")
    out = scratch_path(spark, "t-once")
    publisher(out, 10.0)(df.mapInPandas(touch, df.schema), 0)
    assert seen.value == 10 and spark.read.parquet(out).count() == 20


def test_five_second_trigger(spark):
    """The live trigger itself: two input files, at least one trigger apart."""
    import time
    model = fit_forest(_windows(spark), trees=3)
    src, out = scratch_path(spark, "t-trig-in"), scratch_path(spark, "t-trig-out")
    spark.createDataFrame([(i * 2.0, "1", "10", "5", 0) for i in range(200)], RAW).write.parquet(f"{src}/p=0")
    q = start_live_detector(spark.readStream.schema(RAW).parquet(f"{src}/p=*"), model, 0.0, 100.0, out,
                            scratch_path(spark, "t-trig-ck"), 0.0)
    try:
        end = time.time() + 90
        while not (q.lastProgress and q.lastProgress["numInputRows"]) and time.time() < end:
            time.sleep(0.5)
        spark.createDataFrame([(i * 2.0, "1", "10", "5", 0) for i in range(200, 400)], RAW).write.parquet(f"{src}/p=1")
        while sum(p["numInputRows"] for p in q.recentProgress) < 400 and time.time() < end:
            time.sleep(0.5)
        while q.status["isTriggerActive"] and time.time() < end:
            time.sleep(0.5)
        starts = [p["timestamp"] for p in q.recentProgress if p["numInputRows"]]
        assert len(starts) == 2 and q.exception() is None
    finally:
        q.stop()
    assert spark.read.parquet(out).where("metric = 'ai_anomaly_score'").count() >= 3


def test_training_run(spark):
    from flowsentry.plans.training import train_detector
    from flowsentry.sources import bindings as B
    from conftest import SF_SMALL
    path = scratch_path(spark, "t-train")
    model, report = train_detector(B.flows(spark, SF_SMALL), 3600.0, path, trees=10)
    back, meta = load_detector(path)
    assert meta["n_windows"] == 330 and meta["n_train"] + meta["n_test"] == 330
    assert meta["n_test"] == 99 and 0.0 <= meta["roc_auc"] <= 1.0
    assert report.count() == 1
