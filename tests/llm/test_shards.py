import hashlib
import random
import zlib

import pytest

from conftest import SF_SMALL
from flowsentry.llm import shards
from flowsentry.llm.shards import shard_rows, sharded_documents


def brute(rows, n):
    """Smallest capacity over the documented order, and shard bytes."""
    size = {}
    for _, t in rows:
        size[t] = size.get(t, 0) + len((t or "").encode()) + 8
    total = sum(size.values())

    def place(t):
        h = int(hashlib.md5(t.encode()).hexdigest()[:15], 16) if t is not None else 0
        heavy = size[t] * 64 * n >= total
        return h >> 48, heavy, h
    order = [size[t] for t in sorted(size, key=place)]

    def fill(c):
        out, now = 1, 0
        for x in order:
            if x > c:
                return n + 1
            if now + x > c:
                out, now = out + 1, 0
            now += x
        return out
    lo, hi = 1, total
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fill(mid) <= n else (mid + 1, hi)
    return lo


def check(rows, out, n):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((i is None, i or 0) for i, _ in rows)
    text = dict(rows)
    by, groups = {}, {}
    for r in out:
        t = text[r.doc_id]
        assert r["size"] == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode())
        by.setdefault(r.shard, []).append(r)
        groups.setdefault(t, set()).add(r.shard)
    assert all(len(g) == 1 for g in groups.values())
    assert set(by) <= set(range(n))
    for g in by.values():
        assert sorted(r.slot for r in g) == list(range(len(g)))
    assert max(sum(r["size"] for r in g) for g in by.values()) == brute(rows, n)


@pytest.mark.parametrize("n", [1, 3, 24])
def test_smallest_capacity(spark, n):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], shard_rows(docs, n).collect(), n)


def test_hot_group_narrow_ranges_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(shards, "SPLIT", 3)
    r = random.Random(2)
    rows = [(i, "copy" * 30) for i in range(300)] + [(300 + i, "x" * r.randint(0, 90) + str(i)) for i in range(4000)]
    rows += [(9000, None), (9001, ""), (9002, None), (9003, ""), (None, "q"), (9004, "é" * 4000)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, size int, k string")
    check(rows, shard_rows(df, 24).collect(), 24)
    one = sharded_documents(df.where("doc_id < 3")).collect()
    assert len({x.shard for x in one}) == 1 and {x.law for x in one} == {"bytes"}
    assert shard_rows(df.limit(0)).count() == 0
