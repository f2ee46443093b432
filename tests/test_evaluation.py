import numpy as np
import pandas as pd
import pytest

from flowsentry.operators.evaluation import (
    confusion, detection_metrics, evaluation_report, roc_auc, roc_curve, threshold_sweep,
)

S = "model string, id long, label int, score double, pred int"


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def test_report_identities(spark):
    # 109 TP, 12 FP, 22 FN, 3960 TN -> 0.9008 / 0.8321 / 0.8651
    rows = ([("rf", i, 1, 0.9, 1) for i in range(109)] + [("rf", 200 + i, 0, 0.8, 1) for i in range(12)]
            + [("rf", 300 + i, 1, 0.2, 0) for i in range(22)] + [("rf", 400 + i, 0, 0.1, 0) for i in range(3960)])
    m = detection_metrics(spark.createDataFrame(rows, S)).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (109, 12, 22, 3960)
    assert round(m.precision, 4) == 0.9008 and round(m.recall, 4) == 0.8321
    assert round(m.f1_score, 4) == 0.8651 and round(m.fpr, 5) == 0.00302


def test_single_class(spark):
    df = spark.createDataFrame([("m", 1, 0, 0.3, 0), ("m", 2, 0, 0.6, 1)], S)
    r = evaluation_report(df).first()
    assert r.roc_auc is None and r.precision == 0.0 and r.recall == 0.0 and r.f1_score == 0.0


def test_auc_matches_brute_force_and_symmetry(spark):
    rng = np.random.default_rng(3)
    n = 3000
    y = rng.integers(0, 2, n)
    s = np.round(rng.normal(y * 0.7, 1.0), 1)  # many ties
    pdf = pd.DataFrame({"model": "m", "id": np.arange(n), "label": y.astype("int32"), "score": s,
                        "pred": (s > 0).astype("int32")})
    df = spark.createDataFrame(pdf, S)
    auc = roc_auc(df, buckets=16).first().roc_auc
    assert auc == pytest.approx(brute_auc(y, s), abs=1e-12)
    neg = spark.createDataFrame(pdf.assign(score=-s), S)
    assert roc_auc(neg, buckets=16).first().roc_auc == pytest.approx(1 - auc, abs=1e-12)


def test_roc_curve_endpoints(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 500)
    s = rng.random(500).round(2)
    pdf = pd.DataFrame({"model": "m", "id": np.arange(500), "label": y.astype("int32"), "score": s,
                        "pred": 0})
    pts = roc_curve(spark.createDataFrame(pdf, S), buckets=8).toPandas()
    assert len(pts) == len(np.unique(s)) + 1
    origin = pts[pts.threshold.isna()].iloc[0]
    assert origin.fpr == 0 and origin.tpr == 0
    last = pts.sort_values("threshold").dropna().iloc[0]
    assert last.fpr == 1 and last.tpr == 1
    pts = pts.dropna().sort_values("threshold", ascending=False)
    assert (np.diff(pts.tpr) >= 0).all() and (np.diff(pts.fpr) >= 0).all()


def test_sweep_ties_count_positive(spark):
    df = spark.createDataFrame([("m", 1, 1, 0.5, 0), ("m", 2, 0, 0.4, 0)], S)
    r = {x.threshold: x for x in threshold_sweep(df, [0.5]).collect()}
    assert r[0.5].recall == 1.0
    assert confusion(df).first().tp == 0  # arg-max puts a 0.5 tie in class 0


def test_auc_equals_mllib_exact(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.sql import functions as F
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 2000)
    s = np.round(rng.normal(y * 0.5, 1.0), 2)
    pdf = pd.DataFrame({"model": "m", "id": np.arange(2000), "label": y.astype("int32"), "score": s, "pred": 0})
    df = spark.createDataFrame(pdf, S)
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="lab", numBins=0)
    ml = ev.evaluate(df.withColumn("lab", F.col("label").cast("double")))
    ours = roc_auc(df).first().roc_auc
    assert ours == pytest.approx(brute_auc(y, s), abs=1e-12)  # exact Mann-Whitney
    assert ours == pytest.approx(ml, abs=1e-5)                # MLlib's trapezoid sum


def test_best_model_tie_and_deltas(spark):
    from flowsentry.operators.evaluation import best_model, model_deltas
    rep = spark.createDataFrame(
        [("threshold", 0, 0.5, 0.0), ("isolation", 1, 0.8, 0.0), ("forest", 2, 0.8, 0.9)],
        "model string, model_order int, f1_score double, roc_auc double")
    b = best_model(rep, "f1_score").first()
    assert b.best_model == "isolation" and b.best_value == 0.8      # first model wins the tie
    assert best_model(rep, "roc_auc").first().best_model == "forest"
    d = {r.metric: r for r in model_deltas(rep, "threshold", "forest", ["f1_score", "roc_auc"]).collect()}
    assert d["f1_score"].delta == pytest.approx(0.3) and d["f1_score"].relative == pytest.approx(0.6)
    assert d["roc_auc"].relative == pytest.approx(0.9 / 0.001)          # floor 0.001 on the base


def test_confusion_cells_sum_to_rows(spark):
    from flowsentry.sources import bindings as B
    from conftest import SF_SMALL
    sc = B.scored(spark, SF_SMALL)
    n = {r.model: r["count"] for r in sc.groupBy("model").count().collect()}
    for r in confusion(sc).collect():
        assert r.tp + r.fp + r.fn + r.tn == n[r.model]


def test_sweep_of_many_thresholds(spark):
    from flowsentry.operators.evaluation import sweep_counts
    rng = np.random.default_rng(8)
    n = 4000
    pdf = pd.DataFrame({"model": rng.choice(["a", "b"], n), "id": np.arange(n), "label": rng.integers(0, 2, n).astype("int32"),
                        "score": np.round(rng.random(n), 3), "pred": np.zeros(n, "int32")})
    levels = [*(i / 1000 for i in range(1, 1000)), 0.5, -1.0, 2.0]
    for strict in (False, True):
        got = sweep_counts(spark.createDataFrame(pdf, S), levels, strict=strict).toPandas()
        assert len(got) == 2 * len(levels)
        for m, g in pdf.groupby("model"):
            y, s = g["label"].to_numpy(), g["score"].to_numpy()
            for r in got[got.model == m].itertuples():
                p = s > r.threshold if strict else s >= r.threshold
                assert (r.tp, r.fp, r.fn, r.tn) == (sum(p & (y == 1)), sum(p & (y == 0)), sum(~p & (y == 1)), sum(~p & (y == 0)))


def test_ranges_follow_the_distinct_scores(spark):
    """No task holds more than a few of many distinct scores of one model."""
    from pyspark.sql import functions as F

    from flowsentry.operators import prefix
    from flowsentry.operators.prefix import range_running
    n = 400_000
    df = spark.range(n).select(F.lit("m").alias("model"), (F.col("id") * 7 % n).cast("double").alias("score"),
                               (F.col("id") % 3).alias("neg"))
    old, prefix.RANGE_ROWS = prefix.RANGE_ROWS, 4000
    try:
        out = range_running(df, ["model"], ["score"], "neg", "below", inclusive=False)
        ranges = df.repartitionByRange(1 + n // 4000, "model", "score").groupBy(F.spark_partition_id()).count()
        assert ranges.agg(F.max("count")).first()[0] <= 0.02 * n
        got = {r.score: r.below for r in out.where("score % 50000 = 0").collect()}
    finally:
        prefix.RANGE_ROWS = old
    neg = np.empty(n, int)
    neg[np.arange(n) * 7 % n] = np.arange(n) % 3
    cum = np.concatenate([[0], np.cumsum(neg)])
    assert got == {float(k): (None if k == 0 else cum[k]) for k in range(0, n, 50000)}
