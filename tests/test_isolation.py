import numpy as np
import pandas as pd
import pytest

from flowsentry.operators.evaluation import roc_auc
from flowsentry.operators.isolation import IsolationForest, avg_path_length, contamination_sweep, score_isolation


def test_path_length_constants():
    assert list(avg_path_length([1, 2])) == [0.0, 1.0]
    assert avg_path_length([256])[0] == pytest.approx(10.244770920116851, rel=1e-9)


def test_isolation_forest_separates_outliers(spark):
    rng = np.random.default_rng(0)
    inl = rng.normal(0, 1, (2000, 3))
    out = rng.normal(6, 1, (60, 3))
    x = np.r_[inl, out]
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(
        window=np.arange(len(x)), label=np.r_[np.zeros(2000), np.ones(60)].astype("int32"))
    df = spark.createDataFrame(pdf)
    model = IsolationForest(features=["a", "b", "c"], trees=50, contamination=0.05).fit(df)
    s = score_isolation(model, df).cache()
    assert roc_auc(s).first().roc_auc > 0.95
    rate = s.agg({"pred": "avg"}).first()[0]
    assert 0.03 < rate < 0.07
    # the same forest for a fixed seed, whatever the partitions
    for parts in (3, 7):
        again = IsolationForest(features=["a", "b", "c"], trees=50, contamination=0.05).fit(df.repartition(parts))
        assert again.cut == pytest.approx(model.cut, abs=1e-12)
        assert sorted(map(tuple, again.nodes.collect())) == sorted(map(tuple, model.nodes.collect()))


def test_contamination_sweep_rates(spark):
    pdf = pd.DataFrame({"model": "m", "id": np.arange(1000), "label": (np.arange(1000) >= 990).astype("int32"),
                        "score": np.arange(1000) / 1000.0, "pred": 0})
    df = spark.createDataFrame(pdf)
    r = {x.contamination: x for x in contamination_sweep(df, df).collect()}
    assert r[0.01].tp == 10 and r[0.01].fp == 0 and abs(r[0.01].cutoff - 0.98901) < 1e-12
    assert r[0.005].tp == 5 and r[0.005].fn == 5
    assert r[0.05].recall == 1.0
