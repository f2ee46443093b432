import numpy as np

from flowsentry.llm import vectors
from flowsentry.llm.vectors import near_duplicates
from llm_helpers import roots


def brute(rows, threshold=0.93):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows
          if i is not None and lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all()
          and np.any(v)]
    links = {(a, b) for k, (a, x, p) in enumerate(ok) for b, y, q in ok[k + 1:] if p == q and len(x) == len(y)
             and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold}
    up = roots([i for i, *_ in rows], links)
    return {i: (sum(i in p for p in links), up[i]) for i, *_ in rows}


def make(seed=1, dims=24):
    r = np.random.default_rng(seed)
    base = r.standard_normal((30, dims))
    rows = []
    for i in range(500):
        v = base[r.integers(0, 30)] if i % 3 else base[0]
        v = v + r.standard_normal(dims) * r.choice([0.0, 0.1, 0.25, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v * r.choice([1, 3])], int(i % 2)))
    return rows


def got(df):
    return {r[0]: (r.n_links, r.component_id) for r in df.collect()}


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_recall_precision_and_blocks(spark, monkeypatch):
    rows = make()
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = got(near_duplicates(df))
    assert all(out[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in out.values()) >= 0.99 * sum(n for n, _ in want.values())
    monkeypatch.setattr(vectors, "BLOCK", 16)
    assert got(near_duplicates(df)) == out


def test_edges(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1),
            (6, None, 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 0.0], 1), (10, [], 1),
            (11, [1.0, 0.0], None), (12, [1.0, 0.0, 0.0], 1), (13, [-1.0, 0.0], 1), (14, [1e30, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", cid string, n_links int")
    out = got(near_duplicates(df))
    assert out == brute(rows)
    assert out[1] == (3, 1) and out[14] == (3, 1) and out[5] == (0, 5)
    assert near_duplicates(df.limit(0)).count() == 0
    none = near_duplicates(spark.createDataFrame([(None, [1.0], 1), (2, [1.0], 1)], SCHEMA)).collect()
    assert sorted((r.n_links, r.kept) for r in none) == [(0, True), (0, True)]
