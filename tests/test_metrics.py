import pytest
from pyspark.sql import functions as F

from flowsentry.operators.metrics import (
    counter_increase, counter_sliding, latest, latest_or_zero, lookback, metric_ratio, resample_last, to_metric_samples,
)

M = "metric string, device int, ts double, seq long, value double"


def test_counter_reset(spark):
    df = spark.createDataFrame([("c", 1, float(t), t, v) for t, v in enumerate([10.0, 30.0, 5.0, 9.0])], M)
    r = counter_increase(df, 60.0).first()
    assert r.increase == 29.0
    assert counter_increase(df, 60.0, per_second=True).first().rate == pytest.approx(29 / 60)


def test_no_step_is_lost_at_range_edges(spark):
    v = [(50.0, 10.0), (70.0, 40.0), (110.0, 45.0), (130.0, 90.0)]
    df = spark.createDataFrame([("c", 1, t, i, x) for i, (t, x) in enumerate(v)], M)
    got = {r.range_start: r.increase for r in counter_increase(df, 60.0).collect()}
    assert got == {0.0: 0.0, 60.0: 35.0, 120.0: 45.0} and sum(got.values()) == 80.0


def test_sliding_increase_matches_a_loop(spark):
    import random
    r = random.Random(4)
    rows = sorted((round(r.uniform(0, 500), 3), i) for i in range(400))
    vals = [float(r.randint(0, 50)) for _ in rows]
    data = [("c", i % 2 if i > 300 else 1, t, s, v) for i, ((t, s), v) in enumerate(zip(rows, vals))]
    got = {x.seq: x.increase for x in counter_sliding(spark.createDataFrame(data, M).repartition(5), 60.0).collect()}
    for dev in (0, 1):
        own = [(t, s, v) for _, d, t, s, v in data if d == dev]
        steps = [0.0] + [b[2] if b[2] < a[2] else b[2] - a[2] for a, b in zip(own, own[1:])]
        for t, s, _ in own:
            assert got[s] == sum(x for (u, _, _), x in zip(own, steps)
                                 if round(t * 1e6) - 60_000_000 <= round(u * 1e6) <= round(t * 1e6))


def test_latest_and_default(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1, 5.0), ("a", 1, 2.0, 2, None), ("a", 1, 3.0, 3, 7.0),
                                ("b", 1, 1.0, 4, 1.0)], M)
    got = {(r.metric, r.device): r.value for r in latest(df, 2.5).collect()}
    assert got == {("a", 1): 5.0, ("b", 1): 1.0}
    z = {(r.device, r.metric): r.value for r in latest_or_zero(df, 9.0, ["a", "missing"]).collect()}
    assert z == {(1, "a"): 7.0, (1, "missing"): 0.0}


def test_resample_lookback_ratio(spark):
    df = spark.createDataFrame([("u", 1, 1.0, 1, 10.0), ("u", 1, 4.0, 2, 20.0), ("u", 1, 6.0, 3, 30.0),
                                ("t", 1, 1.0, 1, 100.0), ("t", 1, 4.0, 2, 100.0)], M)
    r = {(x.ts): x.value for x in resample_last(df.where("metric = 'u'"), 5.0).collect()}
    assert r == {5.0: 20.0, 10.0: 30.0}
    assert lookback(df, 2.5).count() == 3  # ts > 6 - 2.5
    pct = {x.seq: x.pct for x in metric_ratio(df, "u", "t", ["device", "ts", "seq"]).collect()}
    assert pct == {1: 10.0, 2: 20.0}


def test_publication(spark):
    w = spark.createDataFrame([(0, 3, 1.5, 10.0, 1)], "window long, flow_count long, avg_duration double, avg_bytes double, label int")
    s = to_metric_samples(w.withColumn("ts", F.col("window") * 10.0), "ts").collect()
    assert {r.metric: r.value for r in s} == {"iot_cyber_flow_count": 3.0, "iot_cyber_avg_flow_duration_sec": 1.5,
                                             "iot_cyber_avg_flow_bytes": 10.0, "iot_cyber_attack_label": 1.0}


def test_metric_source_batch_and_stream(spark):
    from flowsentry.session import scratch_path
    from flowsentry.sources.files import read_metrics
    from flowsentry.streaming.runner import run_available_now
    df = spark.createDataFrame([("u", 1, 1.0, 1, 10.0), ("u", 1, 6.0, 2, 20.0)], M)
    path = scratch_path(spark, "t-metrics")
    df.write.parquet(path)
    assert read_metrics(spark, path).count() == 2
    out = run_available_now(spark, read_metrics(spark, path, streaming=True).where("value > 15"),
                            "t-mstream")
    assert [r.value for r in out.collect()] == [20.0]
