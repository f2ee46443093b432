import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flowsentry.operators.splits import class_quotas, kfold, overlap, stratified_split, warmup_fraction


def _frame(spark, benign, attack):
    pdf = pd.DataFrame({"window": np.arange(benign + attack, dtype="int64"),
                        "label": np.r_[np.zeros(benign), np.ones(attack)].astype("int32")})
    return spark.createDataFrame(pdf)


def test_quotas_reference_sizes(spark):
    q = {r.label: r for r in class_quotas(_frame(spark, 13238, 436)).collect()}
    assert (q[0].train_quota, q[0].test_quota) == (9266, 3972)
    assert (q[1].train_quota, q[1].test_quota) == (305, 131)


def test_split_exact_disjoint_and_ordered(spark):
    df = _frame(spark, 1000, 57)
    s = stratified_split(df).cache()
    counts = {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()}
    q = {r.label: r for r in class_quotas(df).collect()}
    assert counts[(0, "train")] == q[0].train_quota and counts[(1, "test")] == q[1].test_quota
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    assert overlap(train, test).first().n_overlap == 0
    # ranks are 1..n per class in md5 order
    pdf = s.toPandas()
    import hashlib
    for lab, g in pdf.groupby("label"):
        order = sorted(g.window, key=lambda w: (hashlib.md5(f"42:{w}".encode()).hexdigest(), w))
        assert list(g.sort_values("rank").window) == order


def test_kfold_balanced(spark):
    f = kfold(_frame(spark, 103, 12), k=5).toPandas()
    sizes = f.groupby("fold").size()
    assert sizes.max() - sizes.min() <= 2
    per_class = f.groupby(["label", "fold"]).size().unstack()
    assert (per_class.max(axis=1) - per_class.min(axis=1) <= 1).all()


def test_warmup_fraction_size(spark):
    s = stratified_split(_frame(spark, 1000, 50))
    n_train_benign = s.where("split = 'train' AND label = 0").count()
    w = warmup_fraction(s, 0.1)
    assert w.count() == max(1, int(0.1 * n_train_benign))
    assert w.where("label <> 0 OR split <> 'train'").count() == 0
