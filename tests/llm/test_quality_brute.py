"""Scores of the quality model against a plain version on strings."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowsentry.llm import quality as Q
from llm_helpers import ascii_lower


def kind(byte):
    c = chr(byte)
    return "upper" if "A" <= c <= "Z" else "lower" if "a" <= c <= "z" else "digit" if c.isdigit() and byte < 128 \
        else "other" if byte >= 128 else c


def shape(word):
    b = word.encode()
    up, low = sum(kind(x) == "upper" for x in b), sum(kind(x) == "lower" for x in b)
    return kind(b[0]), kind(b[-1]), min(up, 2), low > 0, min(len(b) // 3, 7)


def grams(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    low, s = [ascii_lower(w) for w in words], [shape(w) for w in words]
    out = {("shape", x) for x in s} | {("word", w) for w in low}
    out |= {("words", *p) for p in zip(low, low[1:])} | {("shapes", *p) for p in zip(s, s[1:])}
    return out | {("three", *p) for p in zip(s, s[1:], s[2:])}


def descent(rows, y, seed):
    """Dual coordinate descent on dictionaries of unit length."""
    w, a, r = {}, [0.0] * len(rows), np.random.default_rng(seed)
    for _ in range(Q.EPOCHS):
        worst = 0.0
        for i in r.permutation(len(rows)):
            g = y[i] * math.fsum(w.get(f, 0.0) * v for f, v in rows[i].items()) - 1
            new = min(max(a[i] - g, 0.0), Q.COST)
            worst = max(worst, abs(new - a[i]))
            for f, v in rows[i].items():
                w[f] = w.get(f, 0.0) + (new - a[i]) * y[i] * v
            a[i] = new
        if worst < 1e-3:
            break
    return w


def plain_scores(texts, train):
    """``texts``: all; ``train``: (text, label) in the order of the fit."""
    count = {}
    for t, y in train:
        for g in grams(t):
            count.setdefault(g, [0, 0])[y] += 1
    count = {g: n for g, n in count.items() if sum(n) >= Q.MIN_ROWS}
    total = [sum(n[c] for n in count.values()) + Q.SMOOTH * len(count) for c in (0, 1)]
    scale = {g: math.log((n[1] + Q.SMOOTH) / total[1]) - math.log((n[0] + Q.SMOOTH) / total[0]) for g, n in count.items()}

    def vector(t):
        v = {g: scale[g] for g in grams(t) if g in scale}
        v["bias"] = 1.0
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()}
    rows, sign = [vector(t) for t, _ in train], [2.0 * y - 1 for _, y in train]
    margin = lambda v, w: math.fsum(x * w.get(g, 0.0) for g, x in v.items())
    out = [i % 5 == 0 for i in range(len(rows))]
    part = descent([r for r, o in zip(rows, out) if not o], [s for s, o in zip(sign, out) if not o], Q.SEED)
    m = np.array([margin(r, part) for r, o in zip(rows, out) if o])
    slope, offset = Q._calibrate(m, np.array([y for (_, y), o in zip(train, out) if o]))
    w = descent(rows, sign, Q.SEED)
    return [1 / (1 + math.exp(-(slope * margin(vector(t), w) + offset))) for t in texts]


@pytest.mark.parametrize("modulus", [1, 3])
def test_scores_equal_the_plain_version(spark, modulus):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where(F.col("doc_id") % modulus == 0)
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    label = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    order = [r[0] for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    train = [(text[i], label[i]) for i in order if i in label and zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(train) > 10 and {y for _, y in train} == {0, 1}
    want = dict(zip(order, plain_scores([text[i] for i in order], train)))
    got = {r.doc_id: r.score for r in Q.scored_documents(docs, labels).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in got) < 1e-6


def test_every_row_count_of_an_ngram_can_be_asked_for(spark, monkeypatch):
    """``min_rows`` 1 gives each n-gram a ratio; the bound of the fit is a parameter."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60)
    labelled = docs.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    few, all_ = Q.train(labelled), Q.train(labelled, min_rows=1)
    assert sum(all_["files"][2]) > 3 * sum(few["files"][2])
    size = len(set().union(*({g for g in grams(r.text) if g[0] != "shape"} for r in docs.collect())))
    assert sum(all_["files"][2]) == size
    assert Q.fit_sample(labelled.select(F.col("doc_id").alias("id")), 60, 7).count() == 7
    many = spark.range(50_000).select("id")
    picked = [r.id for r in Q.fit_sample(many, 50_000, 100).collect()]
    assert picked == [r.id for r in many.orderBy(F.xxhash64("id"), "id").limit(100).collect()]
