import hashlib
import random
import zlib

import pytest

from conftest import SF_SMALL
from flowsentry.llm import manifest as M
from llm_helpers import ascii_lower

COLS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def runs_of(nodes):
    """All levels above a list of hashes."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, pos):
    out = []
    for level in levels[:-1]:
        run = pos // 16 * 16
        out.append((level[run:pos], level[pos + 1:run + 16]))
        pos //= 16
    return out


def brute(rows):
    """Rows (doc_id, leaf, subroot, root, proof, folded, verified)."""
    leaf = lambda r: H(*map(field, r))
    names = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, mine = {}, {}
    for s in names:
        mine[s] = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = runs_of([leaf(r) for r in mine[s]])
    top = runs_of([trees[s][-1][0] for s in names])
    out = []
    for n, s in enumerate(names):
        for pos, r in enumerate(mine[s]):
            path = siblings(trees[s], pos) + siblings(top, n)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            x = leaf((*r[:4], None if r[4] is None else ascii_lower(r[4]))) if bad else leaf(r)
            for left, right in path:
                x = H(*left, x, *right)
            proof = "".join("".join(a) + "".join(b) for a, b in path)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], H(proof), x, x == top[-1][0]))
    return sorted(out, key=str)


def digest(df):
    return sorted(map(tuple, M.manifest_digest(df).collect()), key=str)


def test_documents(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in d.collect()]
    want = brute(rows)
    assert digest(d) == want
    assert any(not w[6] for w in want) and any(w[6] for w in want)


@pytest.mark.parametrize("ranges", [100_000, 60])
def test_hot_source_nulls_ties_and_depth(spark, monkeypatch, ranges):
    monkeypatch.setattr(M, "RANGE_ROWS", ranges)
    monkeypatch.setattr(M, "COPY_LEAVES", ranges // 4)
    r = random.Random(3)
    pick = lambda *a: r.choice(a)
    rows = [(i, "hot", "en", i, "Some Text %d" % i) for i in range(700)]
    rows += [(1000 + i, pick(None, "", "b", "é", "Z", "\U0001F600"), pick("de", None), pick(None, 3),
              pick("ABC", "abc", "", None, "ÀÉ Ab", "x" * 40_000 + "Y")) for i in range(200)]
    rows += [(2000 + i, f"one{i:02d}", "en", 1, "Lone %d" % i) for i in range(40)]  # lone leaves, a second top level
    rows += [(None, "hot", "en", 1, "No Id"), (None, None, None, None, None), (None, "b", None, 1, "A"), (None, "b", None, 1, "A")]
    rows += [(5, "hot", "en", 5, "Again"), (5, "hot", "en", 5, "Again"), (5, "b", "en", 5, "Again"), (-7, "b", "en", 5, "Q")]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1, "k", [2]) for x in rows], COLS + ", s int, leaf string, slot array<int>")
    got, want = digest(df), brute(rows)
    assert got == want
    # a tampered text without upper case, or null, is the same text
    by = {w[0]: w[6] for w in want}
    assert all(by[i] for i in by if i is not None and zlib.crc32(str(i).encode()) % 5)
    assert not any(by[i] for i in range(6, 700) if zlib.crc32(str(i).encode()) % 5 == 0)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257])
def test_sizes_of_one_source(spark, n):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    df = spark.createDataFrame(rows, COLS)
    assert digest(df) == brute(rows)


def test_two_lone_sources_and_proof_text(spark):
    rows = [(1, "a", "en", 1, "x"), (2, "b", "en", 1, "y")]
    out = {r.doc_id: r for r in M.manifest(spark.createDataFrame(rows, COLS)).collect()}
    assert out[1].proof == out[2].leaf and out[2].proof == out[1].leaf
    assert out[1].root == H(out[1].leaf, out[2].leaf) and out[1].subroot == out[1].leaf
