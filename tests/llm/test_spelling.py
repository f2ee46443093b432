import random
import re
import zlib
from collections import Counter

import pytest

from conftest import SF_SMALL
from flowsentry.llm import spelling as S
from llm_helpers import ascii_lower


def counted(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n, ratio=5):
    form, count = {}, {}
    for w in n:
        all_ = [v for v in n if v != w and near(w, v)]
        best = min(all_, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        count[w] = len(all_)
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_documents(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    n = counted([(r.doc_id, r.text) for r in d.collect()])
    assert dict(map(tuple, S.word_counts(d).collect())) == n
    assert got(S.spelling_variants(d)) == brute(n)


@pytest.mark.parametrize("heavy,letters,block", [(50_000, "ab", 64), (20, "abÀé", 3), (3, "xyz", 1)])
def test_dense_vocabularies(spark, monkeypatch, heavy, letters, block):
    """Words over few letters: every position has neighbours, many by runs of
    equal letters; names in blocks shorter than the words."""
    monkeypatch.setattr(S, "HEAVY", heavy)
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "RANGE_WORDS", 50)
    r = random.Random(heavy)
    n = {}
    while len(n) < 250:
        n["".join(r.choices(letters, k=r.randint(6, 9)))] = 5 ** r.randint(1, 6) + r.randint(0, 1)
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    want = brute(n)
    assert got(S.variants(df)) == want
    assert any(w[4] for w in want)
    assert letters != "ab" or any(w[1] and w[2] != w[1] for w in want)  # chains of forms


def test_odd_rows_and_long_words(spark):
    long = "q" * 5000 + "z"
    rows = [(i, "Übung ÜBUNGEN übungen wörter-buch abcdefg" + "×" + " abcdefx x1abcdefx") for i in range(20)]
    rows += [(None, "abcdefg " * 7), (None, None), (3, None), (4, ""), (5, "12 34"), (5, "12 34"), (6, "ĀbcdefgĀ abcdeﬀ")]
    rows += [(100 + i, long + " " + "q" * 5000 + " a" + "q" * 5000 + "z") for i in range(6)]
    df = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], "doc_id long, text string, word string, n int, id int")
    n = counted(rows)
    out = got(S.spelling_variants(df))
    assert out == brute(n)
    assert {w[4] for w in out if len(w[0]) >= 5000} == {1, 2}
    assert S.spelling_variants(df.limit(0)).count() == 0
    assert S.spelling_variants(df.where("doc_id = 5")).count() == 0
