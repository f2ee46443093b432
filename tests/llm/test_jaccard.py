import random

import pytest

from conftest import SF_MID, SF_SMALL
from flowsentry.llm import jaccard
from flowsentry.llm.jaccard import jaccard_components
from llm_helpers import roots, words


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = sorted(sets)
    post, links = {}, set()
    for i in ids:
        for s in sets[i]:
            post.setdefault(s, []).append(i)
    for group in post.values():
        for x, a in enumerate(group):
            for b in group[x + 1:]:
                if (a, b) not in links:
                    n = len(sets[a] & sets[b])
                    if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                        links.add((a, b))
    up = roots(ids, links)
    return {i: (len(sets[i]), up[i]) for i in ids}


def got(df):
    return {r[0]: (r[1], r[2]) for r in df.collect()}


@pytest.mark.parametrize("k,percent,sf", [(3, 90, SF_SMALL), (5, 80, SF_MID)])
def test_equals_all_pairs_on_the_table(spark, k, percent, sf):
    """(3, 90) on the larger table is held against SQL by the entry."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(jaccard_components(docs, k=k, percent=percent)) == brute(rows, k, percent)


@pytest.mark.parametrize("blocks", [(256, 4096), (3, 7)])
def test_large_group_of_near_copies(spark, monkeypatch, blocks):
    """Many edited copies of one text, split into small blocks too."""
    monkeypatch.setattr(jaccard, "LEFT", blocks[0])
    monkeypatch.setattr(jaccard, "RIGHT", blocks[1])
    r = random.Random(5)
    base = [r.choice("abcdefghij") + str(r.randint(0, 99)) for _ in range(90)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = "x" + str(r.randint(0, 9999))
        rows.append((i * 7, " ".join(w)))
    rows += [(9000 + i, " ".join(base[:60])) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(jaccard_components(df)) == brute(rows, 3, 90)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"),
            (8, "one two three"), (9, "É one"), (10, "é one"), (11, "w " * 5000), (12, "w w w w"), (13, "x" * 100000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows],
                               "doc_id long, text string, component_id string, n long")
    out = got(jaccard_components(df))
    assert out == brute(rows, 3, 90)
    assert out[1] == (0, 1) and out[5][1] == 4 and out[7][1] == 6 and out[10][1] == 10 and out[12][1] == 11
    assert jaccard_components(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(nulls).collect()), key=str) == [(2, 1, 2), (2, 1, 2), (None, 1, None)]
