import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from conftest import ROOT
from flowsentry.operators import stages as ST
from flowsentry.operators.forest import fit_forest
from flowsentry.operators.isolation import IsolationForest
from flowsentry.operators.scaling import ZScaler
from flowsentry.session import scratch_path

SCHEMA = "window long, flow_count long, avg_duration double, avg_bytes double, label int"


def data(spark, n=400):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.poisson(6)) + 12 * (i % 9 == 0), float(rng.normal()), float(rng.gamma(2)), int(i % 9 == 0 or i % 31 == 0))
            for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_scaler_stage_equals_scaler_and_checks_input(spark):
    d = data(spark).withColumn("same", F.lit(3.0))
    cols = ["flow_count", "avg_bytes", "same"]
    m = ST.ZScale(inputCols=cols, outputCols=["a", "b", "c"]).fit(d)
    ref = ZScaler(cols).fit(d).transform(d).orderBy("window").collect()
    for x, y in zip(m.transform(d).orderBy("window").collect(), ref):
        assert (x.a, x.b, x.c) == pytest.approx((y.z_flow_count, y.z_avg_bytes, y.z_same)) and x.c == 0.0
    nulls = d.withColumn("avg_bytes", F.when(F.col("window") > 3, F.col("avg_bytes")))
    assert ST.ZScale(inputCols=cols, outputCols=["a", "b", "c"]).fit(nulls).transform(nulls).where("b is null").count() == 4
    with pytest.raises(ValueError, match="avg_bytes"):
        ST.ZScale(inputCols=["avg_bytes"], outputCols=["b"]).fit(d.limit(0))


@pytest.mark.parametrize("kind", ["isolation_forest", "random_forest"])
def test_pipeline_saved_and_loaded_in_a_fresh_session(spark, kind):
    d = data(spark)
    d.write.parquet(rows := scratch_path(spark, "t-rows"))
    model = ST.detector_pipeline(kind, trees=12).fit(d)
    model.write().overwrite().save(path := scratch_path(spark, "t-detector"))
    want = model.transform(d).select("window", "z_flow_count", "score", "pred").orderBy("window").collect()
    assert len({r.score for r in want}) > 5 and {r.pred for r in want} == {0, 1}
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from flowsentry.session import get_spark
from pyspark.ml import PipelineModel
spark = get_spark("local[2]", shuffle_partitions=2)
m = PipelineModel.load({path!r})
for r in m.transform(spark.read.parquet({rows!r})).select("window", "z_flow_count", "score", "pred").orderBy("window").collect():
    print("ROW", *map(repr, r))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    got = [line.split()[1:] for line in out.stdout.splitlines() if line.startswith("ROW")]
    assert got == [list(map(repr, r)) for r in want], out.stderr[-2000:]
    # the same on a stream
    back = PipelineModel.load(path)
    stream = spark.readStream.schema(d.schema).parquet(rows)
    q = back.transform(stream).select("window", "z_flow_count", "score", "pred").writeStream.format("memory") \
        .queryName(f"t_{kind}").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table(f"t_{kind}").orderBy("window").collect() == want
    # copies keep params and table
    again = back.copy()
    assert again.transform(d).select("window", "z_flow_count", "score", "pred").orderBy("window").collect() == want


def test_isolation_stage_equals_the_operator(spark):
    d = data(spark)
    z = ST.ZScale().fit(d).transform(d)
    a = ST.IsolationStage(trees=15, contamination=0.1).fit(z)
    b = IsolationForest(features=list(ST.Z_FEATURES), trees=15, contamination=0.1).fit(z)
    x = a.transform(z).orderBy("window").collect()
    y = b.decide(b.score(z)).orderBy("window").collect()
    assert [(r.score, r.decision, r.pred) for r in x] == [(r.anomaly_score, r.decision, r.pred) for r in y]
    assert 20 <= sum(r.pred for r in x) <= 40


@pytest.mark.parametrize("least", [2, 5, 40])
def test_least_split_size_on_every_node(spark, least):
    d = data(spark)
    grown = fit_forest(d, trees=8)
    full = ST.forest_nodes(grown).collect()
    rows = {(r.tree, r.node): r for r in full}
    kept = {(r.tree, r.node): r for r in ST.collapse(ST.forest_nodes(grown), least).collect()}

    def below(key):
        """Nodes of the tree that never splits fewer than ``least`` rows."""
        r = rows[key]
        out = {key}
        if r.feature >= 0 and r.n >= least:
            out |= below((r.tree, r.left)) | below((r.tree, r.right))
        return out
    want = set().union(*(below((t, 0)) for t in range(8)))
    assert set(kept) == want
    for key, r in kept.items():
        o = rows[key]
        leaf = o.feature < 0 or o.n < least
        assert (r.feature, r.left) == ((-1, -1) if leaf else (o.feature, o.left)) and r.value == o.value
        if not leaf:
            assert rows[(r.tree, r.left)].n + rows[(r.tree, r.right)].n == r.n >= least

    def one(x, tree):
        r = rows[(tree, 0)]
        while r.feature >= 0 and r.n >= least:
            r = rows[(tree, r.left if x[r.feature] <= r.split else r.right)]
        return r.value
    model = ST.ForestStageModel()
    model._set(inputCols=["flow_count", "avg_duration", "avg_bytes"])
    model.nodes = ST.collapse(ST.forest_nodes(grown), least)
    for r in model.transform(d).collect():
        p = np.mean([one((r.flow_count, r.avg_duration, r.avg_bytes), t) for t in range(8)])
        assert r.score == pytest.approx(p, abs=1e-12) and r.pred == int(r.score > 0.5)
    if least == 2:  # nothing collapses: the forest as grown
        ml = {r.window: float(r.probability[1]) for r in grown.transform(d.withColumn("label", F.col("label").cast("double"))).collect()}
        assert all(r.score == pytest.approx(ml[r.window], abs=1e-12) for r in model.transform(d).collect())
        imp = {r.feature: r.importance for r in model.importances().collect()}
        ref = dict(zip(model.getInputCols(), grown.stages[-1].featureImportances.toArray()))
        assert imp == pytest.approx(ref, abs=1e-9)


def test_forest_stage_on_a_single_class(spark):
    d = data(spark, 40).withColumn("label", F.lit(0))
    out = ST.detector_pipeline("random_forest", trees=3).fit(d).transform(d)
    assert {(r.score, r.pred) for r in out.collect()} == {(0.0, 0)}
