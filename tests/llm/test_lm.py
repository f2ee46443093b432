import math
from collections import Counter, defaultdict

import pytest

from conftest import SF_SMALL
from flowsentry.llm import lm
from llm_helpers import words


def brute(train, texts):
    """The model written out with dictionaries."""
    seqs = [[*words(t), "</s>"] for t in train]
    c1 = Counter(w for s in seqs for w in s)
    c2 = Counter(p for s in seqs for p in zip([None, *s], s))
    left, ctx = Counter(w for _, w in c2), defaultdict(Counter)
    for (v, w), n in c2.items():
        ctx[v][w] = n

    def disc(counts):
        n = [sum(1 for x in counts if x == k) for k in (1, 2, 3, 4)]
        if min(n) > 0:
            y = n[0] / (n[0] + 2 * n[1])
            d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
            if all(0 < x < k for x, k in zip(d, (1, 2, 3))):
                return d
        return [0.5, 1.0, 1.5]
    d2, d1 = disc(c2.values()), disc(left.values())
    n_all, v_all, lt = sum(c1.values()), len(c1), sum(left.values())

    def cut(n, d):
        return d[min(n, 3) - 1] if n else 0
    rest = sum(cut(n, d1) for n in left.values()) / lt if lt else 1.0

    def p1(w):
        return (left[w] - cut(left[w], d1)) / max(lt, 1) + rest / (v_all + 1)

    def p2(w, v):
        if v not in ctx:
            return p1(w)
        t = sum(ctx[v].values())
        n = ctx[v][w]
        return (n - cut(n, d2)) / t + sum(cut(x, d2) for x in ctx[v].values()) / t * p1(w)
    out = []
    for t in texts:
        s = [*words(t), "</s>"]
        out.append((len(s), sum(1 for w in s if c1[w]),
                    sum(math.log10((c1[w] + 0.1) / (n_all + 0.1 * (v_all + 1))) for w in s),
                    sum(math.log10(p2(w, v)) for v, w in zip([None, *s], s))))
    return out, n_all, (p2, c1)


@pytest.mark.parametrize("sizes", [(1 << 21, 1 << 20, 1 << 22), (500, 300, 700)])
def test_equals_dictionaries(spark, monkeypatch, sizes):
    for name, x in zip(("BUFFER", "VOCAB_SHARD", "PAIR_SHARD"), sizes):
        monkeypatch.setattr(lm, name, x)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(3)
    rows = docs.collect()
    import zlib
    train = [r.text for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10]
    want, n, _ = brute(train, [r.text for r in rows])
    got = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    assert len(got) == len(rows)
    for r, (nt, known, base, lp) in zip(rows, want):
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (nt, known, n)
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert math.isclose(g.base_score, base, rel_tol=1e-9)
        assert math.isclose(g.score, lp, rel_tol=1e-9)


def test_probabilities_sum_to_one():
    train = ["a b a c", "a b", "c c c a b d", "e"]
    _, _, (p2, c1) = brute(train, [])
    for v in [None, "a", "b", "c", "d", "zz"]:
        assert math.isclose(sum(p2(w, v) for w in [*c1, "unknown"]), 1, rel_tol=1e-12)


def test_edges(spark):
    schema = "doc_id long, text string, score string"
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "A  b\n" * 20000, "x"),
                                (3, "q", "x")], schema)
    out = lm.score_documents(df).collect()
    assert sorted(r.n_tokens for r in out) == [1, 1, 2, 3, 40001]
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out)
    assert lm.score_documents(df.limit(0)).count() == 0
    empty = lm.train(df.limit(0))
    assert [r.score for r in lm.score(df.limit(2), empty).collect()] == [0.0, 0.0]


def test_frequent_context_is_split(spark, monkeypatch):
    monkeypatch.setattr(lm, "PAIR_SHARD", 500)
    monkeypatch.setattr(lm, "BUFFER", 800)
    texts = [" ".join(f"the x{i * 300 + j}" for j in range(300)) for i in range(10)]
    texts += [f"x{i} the end" for i in range(600)]  # more than 500 row starts, too
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = lm.train(df)
    sizes = [len(lm.get(model["folder"], f"pair-{s}")) for s in model["full"]]
    assert max(sizes) <= 1000 and sum(sizes) > 6000  # "the" has 3,001 followers
    held = ["the x1 the x2", "the nothing", "x5 the end", "", "the"]
    want, _, _ = brute(texts, held)
    got = lm.score(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"), model).collect()
    assert len(got) == len(held)
    for r in got:
        assert math.isclose(r.score, want[r.doc_id][3], rel_tol=1e-9)


def test_arrays_through_a_store(tmp_path, monkeypatch):
    """A folder that only a store opens: mapped from a copy that leaves no file."""
    import os
    import tempfile

    import numpy as np
    from pyarrow import fs

    from flowsentry.llm import lm
    monkeypatch.setattr(lm, "_local", lambda folder: None)
    monkeypatch.setattr(lm, "_store", lambda folder: (fs.LocalFileSystem(), str(tmp_path / "far")))
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path / "near"))
    os.makedirs(tmp_path / "near")
    a = np.arange(100_000)
    lm.put("far://x", "a", a)
    got = lm.get("far://x", "a")
    assert isinstance(got, np.memmap) and (got == a).all() and not os.listdir(tmp_path / "near")


def brute3(train, texts):
    """Order 3 written out with dictionaries."""
    seqs = [[*words(t), "</s>"] for t in train]
    c1 = Counter(w for s in seqs for w in s)
    c3 = Counter(p for s in seqs for p in zip([None, None, *s], [None, *s], s))
    c2 = Counter((b, c) for _, b, c in c3)
    left = Counter(c for _, c in c2)

    def disc(counts):
        n = [sum(1 for x in counts if x == k) for k in (1, 2, 3, 4)]
        if min(n) > 0:
            y = n[0] / (n[0] + 2 * n[1])
            d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
            if all(0 < x < k for x, k in zip(d, (1, 2, 3))):
                return d
        return [0.5, 1.0, 1.5]

    def cut(n, d):
        return d[min(n, 3) - 1] if n else 0

    def layer(counts, lower):
        d, of = disc(counts.values()), defaultdict(Counter)
        for k, n in counts.items():
            of[k[:-1]][k[-1]] = n

        def p(w, *v):
            got = of.get(v)
            if not got:
                return lower(w, *v[1:])
            t = sum(got.values())
            return (got[w] - cut(got[w], d)) / t + sum(cut(x, d) for x in got.values()) / t * lower(w, *v[1:])
        return p
    d1, lt = disc(left.values()), sum(left.values())
    rest = sum(cut(n, d1) for n in left.values()) / lt if lt else 1.0
    p1 = lambda w: (left[w] - cut(left[w], d1)) / max(lt, 1) + rest / (len(c1) + 1)
    p3 = layer(c3, layer(c2, p1))
    return [sum(math.log10(p3(w, a, b)) for a, b, w in zip([None, None, *s], [None, *s], s))
            for s in ([*words(t), "</s>"] for t in texts)], (p3, c1)


@pytest.mark.parametrize("sizes", [(1 << 21, 1 << 20, 1 << 22), (500, 300, 700)])
def test_order_three_equals_dictionaries(spark, monkeypatch, sizes):
    for name, x in zip(("BUFFER", "VOCAB_SHARD", "PAIR_SHARD"), sizes):
        monkeypatch.setattr(lm, name, x)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(3)
    rows = docs.collect()
    import zlib
    train = [r.text for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10]
    want, _ = brute3(train, [r.text for r in rows])
    two, n, _ = brute(train, [r.text for r in rows])
    got = {r.doc_id: r for r in lm.score_documents(docs, order=3).collect()}
    for r, lp, (nt, known, base, _) in zip(rows, want, two):
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (nt, known, n)
        assert math.isclose(g.base_score, base, rel_tol=1e-9) and math.isclose(g.score, lp, rel_tol=1e-9)


def test_order_three_edges(spark):
    train = ["a b a c", "a b", "c c c a b d", "e", "", None]
    _, (p3, c1) = brute3(train, [])
    for v in [(None, None), (None, "a"), ("a", "b"), ("c", "c"), ("zz", "a"), ("a", "zz")]:
        assert math.isclose(sum(p3(w, *v) for w in [*c1, "unknown"]), 1, rel_tol=1e-12)
    # counts above 255, words unseen, a frequent context in parts
    texts = [*train, "x y z " * 400, "x y w", "zz"] + [f"q{i} the r{i % 7}" for i in range(300)]
    held = ["x y z x y z", "x y w", "new x y new", "", "a b d", "q1 the r1 the r2"]
    want, _ = brute3(texts, held)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = lm.train(df, order=3)
    got = lm.score(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"), model).collect()
    assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-9) for r in got) and len(got) == len(held)
    empty = lm.train(df.limit(0), order=3)
    assert all(r.score == 0.0 for r in lm.score(df.limit(2), empty).collect())
    with pytest.raises(ValueError, match="order"):
        lm.train(df, order=4)
