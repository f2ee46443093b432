import numpy as np
import pandas as pd
import pytest

from flowsentry.operators.stats import histogram, stats_by_class, stats_overall, trimmed_stats


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.gamma(2.0, 3.0, 5000).round(3)
    got = histogram(spark.createDataFrame(pd.DataFrame({"x": x})), "x", 30).toPandas().sort_values("bin")
    counts, edges = np.histogram(x, bins=30)
    assert got.n.tolist() == counts.tolist()
    assert np.allclose(got.lo.to_numpy(), edges[:-1]) and np.allclose(got.hi.to_numpy(), edges[1:])


def test_histogram_constant_column(spark):
    got = histogram(spark.createDataFrame(pd.DataFrame({"x": [5.0] * 7})), "x", 40).toPandas()
    counts, edges = np.histogram(np.full(7, 5.0), bins=40)
    assert got.sort_values("bin").n.tolist() == counts.tolist()


def test_stats_missing_class_and_flavours(spark):
    pdf = pd.DataFrame({"label": [0, 0, 0], "cpu": [1.0, 2.0, 4.0], "ram": [1.0, 1.0, 1.0],
                        "latency": [3.0, 3.0, 6.0]})
    df = spark.createDataFrame(pdf)
    r = {x.metric: x for x in stats_by_class(df).collect()}
    assert r["cpu"].attack_mean == 0.0 and r["cpu"].attack_std == 0.0 and r["cpu"].attack_n == 0
    assert r["cpu"].baseline_std == pytest.approx(np.std([1.0, 2.0, 4.0]))          # population
    o = {x.metric: x for x in stats_overall(df).collect()}
    assert o["cpu"].std == pytest.approx(pd.Series([1.0, 2.0, 4.0]).std())          # sample
    t = trimmed_stats(spark.createDataFrame(pd.DataFrame({"latency": np.arange(1, 101, dtype=float)})),
                      "latency").first()
    kept = np.arange(1, 101, dtype=float)
    kept = kept[kept <= np.percentile(kept, 99)]
    assert t.n == len(kept) and t.mean == round(kept.mean(), 4) and t.p99 == round(np.percentile(kept, 99), 4)


def test_cross_validation_folds(spark):
    from pyspark.sql import functions as F
    from flowsentry.operators.forest import cross_validate
    rng = np.random.default_rng(2)
    n = 400
    lab = (rng.random(n) < 0.2).astype("int32")
    pdf = pd.DataFrame({"window": np.arange(n), "flow_count": (rng.poisson(5, n) + lab * 10).astype("int64"),
                        "avg_duration": rng.random(n), "avg_bytes": rng.random(n) * 100 + lab * 50,
                        "label": lab})
    cv = cross_validate(spark.createDataFrame(pdf), k=3, trees=10, depth=5).toPandas()
    assert sorted(cv.fold) == [0, 1, 2] and (cv.f1 > 0.8).all()
    assert cv.mean_f1.iloc[0] == pytest.approx(cv.f1.mean()) and cv.std_f1.iloc[0] == pytest.approx(cv.f1.std(ddof=0))


@pytest.mark.parametrize("n", [1, 2, 3, 11, 100, 2500])
def test_exact_quantiles_of_any_size(spark, n):
    from flowsentry.operators.stats import exact_quantiles
    rng = np.random.default_rng(n)
    x = rng.normal(size=n).round(2)
    probs = [0.0, 0.005, 0.25, 0.5, 0.9, 0.99, 1.0]
    for accuracy in (50, 1000):
        got = exact_quantiles(spark.createDataFrame(pd.DataFrame({"x": x})), "x", probs, accuracy=accuracy).first()
        assert [got[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(x, probs)), abs=1e-12)


def test_sketches_merge_over_days(spark):
    from flowsentry.operators.stats import SKETCH_ERROR, daily_sketches, sketch_quantiles
    rng = np.random.default_rng(4)
    n = 60_000
    pdf = pd.DataFrame({"ts": rng.random(n) * 86400 * 9, "k": rng.choice(["a", "b"], n), "x": rng.gamma(2, 1, n)})
    days = daily_sketches(spark.createDataFrame(pdf), "x", by=["k"])
    assert days.count() == 18 and max(len(r.sketch) for r in days.collect()) < 20_000
    for r in sketch_quantiles(days, [0.1, 0.5, 0.99], ["k"]).collect():
        x = np.sort(pdf.x[pdf.k == r.k])
        assert r.n == len(x)
        for q, p in ((r.q0, 0.1), (r.q1, 0.5), (r.q2, 0.99)):
            assert abs(np.searchsorted(x, q) / len(x) - p) < SKETCH_ERROR
