import random

import pytest

from conftest import SF_MID
from flowsentry.llm import suffixes
from flowsentry.llm.suffixes import drop_repeats, repeated_spans
from llm_helpers import words


def brute(rows, n=50):
    """Word positions in repeated windows, and those to remove."""
    seen = {}
    toks = {i: words(t) for i, t in rows}
    for i, w in sorted(toks.items()):
        for p in range(len(w) - n + 1):
            seen.setdefault(tuple(w[p:p + n]), []).append((i, p))
    rep, cut, own = {}, {}, {}
    for where in seen.values():
        if len(where) > 1:
            for i, p in where:
                rep.setdefault(i, set()).update(range(p, p + n))
                if (i, p) != where[0]:
                    cut.setdefault(i, set()).update(range(p, p + n))
                    if i == where[0][0]:
                        own.setdefault(i, set()).update(range(where[0][1], where[0][1] + n))
    return {i: (len(rep[i]), cut.get(i, set()) - own.get(i, set())) for i in rep}


def got(df):
    return {r.doc_id: (r.n_repeated, {x for s in r.removed for x in range(s.lo, s.hi)}) for r in df.collect()}


def test_equals_every_window_on_the_table(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    assert got(repeated_spans(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("heavy", [20_000, 3])
def test_random_overlaps(spark, monkeypatch, heavy):
    monkeypatch.setattr(suffixes, "HEAVY", heavy)
    r = random.Random(3)
    parts = [[f"w{r.randint(0, 500)}" for _ in range(r.randint(30, 80))] for _ in range(12)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(parts)
            a = r.randint(0, 12)
            w += p[a:len(p) - r.randint(0, 8)] + [f"z{r.randint(0, 9999)}" for _ in range(r.randint(0, 2))]
        rows.append((i, " ".join(w)))
    rows += [(100, "the " * 300), (101, "a b " * 200), (102, "the " * 49), (103, None), (104, ""),
             (105, "Q" * 90000), (106, "THE\n" * 60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, removed string").repartition(6)
    want = brute(rows)
    assert got(repeated_spans(df)) == want
    kept = {r.doc_id: r.text for r in drop_repeats(df).collect()}
    for i, t in rows:
        w, cut = words(t), want.get(i, (0, set()))[1]
        left = [x for k, x in enumerate(w) if k not in cut]
        assert (words(kept[i]) == left) if left or not w else i not in kept
    assert kept[103] is None and kept[104] == "" and kept[105] == "Q" * 90000


def test_many_stretches_take_little_memory():
    """A full batch of 2,000 texts with 60 windows each, copies of which every
    third has its first place in the same text."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    rows, n = 2000, 60
    lo = np.tile(np.arange(n), rows) + np.repeat(np.arange(rows) % 7, n)
    wins = lo << 32 | (lo + 50) << 1 | 1
    offs = pa.array(np.arange(rows + 1, dtype=np.int32) * n)
    own = pa.ListArray.from_arrays(pa.array((np.arange(rows + 1) + 2) // 3, pa.int32()),
                                   pa.array([5 << 32 | 15 << 1] * ((rows + 2) // 3), pa.int64()))
    tracemalloc.start()
    repeated, removed, spans = suffixes._removed(pa.ListArray.from_arrays(offs, pa.array(wins)), own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # objects for each stretch took 60 MB and more
    assert repeated.to_pylist() == [n + 49] * rows
    for r in (0, 1, 2, 3, 6, 1998, 1999):
        a, z = r % 7, r % 7 + n + 49
        want = [(a, z)] if r % 3 else [x for x in ((a, 5), (max(a, 15), z)) if x[0] < x[1]]
        assert [(x["lo"], x["hi"]) for x in spans[r].as_py()] == want
        assert removed[r].as_py() == sum(y - x for x, y in want)


def test_sets_hold_numbers(spark):
    """Sets of structs filled the heap of an executor."""
    import re
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = repeated_spans(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(" in plan and not re.search(r"collect_set\((if|struct|CASE)", plan)


def test_edges(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")
    assert got(repeated_spans(df)) == {1: (60, set())}
    assert drop_repeats(df).count() == 3
    assert repeated_spans(df.limit(0)).count() == 0 and drop_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeated_spans(df, min_words=10)
