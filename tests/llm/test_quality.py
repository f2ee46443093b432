import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SF_MID
from flowsentry.llm import quality as Q
from flowsentry.llm import textkit as T


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    out = Q.scored_documents(docs, labels).cache()
    assert out.count() == docs.count() and out.where("score < 0 or score > 1").count() == 0
    held = out.where("held_out").join(labels, "doc_id")
    assert held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9


def test_counts_cover_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(Q, "BUFFER", 50)
    texts = ["Good words here", "GOOD WORDS!!", "x y", "", None, "good words"]
    rows = [(i, t, i % 2) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "id long, t string, y int").repartition(3)
    want = np.zeros((2, Q.BIAS + 1))
    for _, t, y in rows:
        for w in T.word_pieces(pa.array([t]), lower=False):
            want[y][Q.features(w)[1]] += 1
    assert (Q._count(df) == want).all()


def test_descent_reaches_the_hinge_optimum():
    r = np.random.default_rng(0)
    rows = [np.unique(np.append(r.integers(0, 20, 6), 20)) for _ in range(60)]
    scale, y = np.append(r.uniform(0.5, 1.5, 20), 1.0), r.choice([-1.0, 1.0], 60)
    x = np.zeros((60, 21))
    for i, f in enumerate(rows):
        x[i, f] = scale[f] / np.linalg.norm(scale[f])

    def loss(w):
        return 0.5 * w @ w + Q.COST * np.maximum(0, 1 - y * (x @ w)).sum()
    w = Q.dual_coordinate_descent(rows, scale, y, epochs=4000).astype(float)
    best = loss(w)
    for _ in range(300):  # no direction improves a convex loss at its optimum
        assert loss(w + r.standard_normal(21) * r.choice([1e-3, 1e-2, 0.3])) >= best - 1e-3


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(
        ["fine text here", None, "", "B" * 50000, "bad!!", "fine text"])], "doc_id long, text string, quality string, _y int")
    labels = spark.createDataFrame([(0, 1), (4, 0), (4, 1), (5, 1), (5, 1), (1, 0), (None, 1), (2, None)],
                                   "doc_id long, quality int")
    out = Q.scored_documents(docs, labels).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: r.quality for r in Q.with_labels(docs, labels).collect()}
    assert got == {0: 1, 5: 1, 1: 0}  # differing labels of one id are no label
    none = Q.scored_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert Q.scored_documents(docs.limit(0), labels).count() == 0


def test_every_gram_has_its_own_ratio(spark, monkeypatch):
    monkeypatch.setattr(Q, "BUFFER", 5000)
    monkeypatch.setattr(Q, "SHARD", 100_000)
    docs = [(i, " ".join(f"n{(i // 4) * 400 + j}" for j in range(400)), i % 4 == 3) for i in range(4000)]
    df = spark.createDataFrame(docs, "id long, t string, y boolean").withColumn("y", F.col("y").cast("int"))
    kept = Q._count_grams(df).where(F.col("neg") + F.col("pos") >= Q.MIN_ROWS)
    # 400,000 words and 399,000 pairs in four rows each, one of label 1
    own = kept.where("neg = 3 and pos = 1")
    assert own.count() >= 799_000
    size, total = own.count(), np.array([3.0 * own.count(), 1.0 * own.count()])
    files = Q._write_ratios(own, size, total)
    assert files[1] and sum(files[2]) == size
    w = next(T.word_pieces(pa.array(["n7 n8", "n8 n7"]), lower=False))
    row, key = Q.grams(w)
    word = key[row == 0]
    table = Q.Grams(*files)
    ids = table.vocab.ids(key)
    want = np.log(2 / total[1]) - np.log(4 / total[0])
    got = table.read("ratio", ids)
    # "n8 n7" is unknown; both rows' words and shape runs and "n7 n8" are not
    assert (ids >= 0).sum() == 7 and np.allclose(got[ids >= 0], want) and len(word) == 4
