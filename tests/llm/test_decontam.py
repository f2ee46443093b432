import re

import pytest

from flowsentry.llm.decontam import contamination, contamination_digest, drop_contaminated
from llm_helpers import ascii_lower

SEP = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(docs, items, n=10):
    wins = {}
    for i, t in items:
        w = re.findall(SEP, ascii_lower(t or ""))
        if i is not None and w:
            k = min(len(w), n)
            for s in range(len(w) - k + 1):
                wins.setdefault(tuple(w[s:s + k]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = re.findall(SEP, ascii_lower(t or ""))
        hit, got = set(), set()
        for k in {len(x) for x in wins}:
            for s in range(len(w) - k + 1):
                x = wins.get(tuple(w[s:s + k]))
                if x:
                    got |= x
                    hit |= set(range(s, s + k))
        out.append((i, len(w), len(hit), sorted(got)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r[0], r.n_words, len({p for h in r.hits for p in range(h.s, h.s + h["size"])}), r["items"])
                   for r in df.collect()), key=str)


def test_windows_short_items_and_edges(spark):
    a = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(a[:15])), (2, "Alpha, BETA"), (3, None), (4, "  ,. "), (5, "alpha"),
             (6, "É été " + " ".join(a[20:27])), (10, " ".join(a[5:15])), (None, "x y z"), (7, "same " * 12)]
    docs = [(1, " ".join(a)), (2, "no " + "; ".join(a[:9]) + " no"), (3, None), (4, ""), (5, "alpha-beta alpha"),
            (6, "É  ÉTÉ " + " ".join(a[20:27])), (7, "é été " + " ".join(a[20:27])), (8, "same " * 11), (9, "same " * 9),
            (9, "W0 " * 30), (None, " ".join(a[3:14])), (1, " ".join(a)), (12, "q" * 100000), (13, "x y z"),
            (14, " ".join(a[:10]) + "\x00" + " ".join(a[5:15]))]
    d = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, words string, s int")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, prints int")
    assert rows(contamination(d, b)) == brute(docs, items)
    bad = {r[0] for r in brute(docs, items) if r[2]}
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted((r[0] for r in kept.collect()), key=str) == sorted((i for i, _ in docs if i not in bad), key=str)
    assert rows(contamination(d, b.limit(0))) == brute(docs, [])
    assert contamination_digest(d.limit(0), b).count() == 0


@pytest.mark.parametrize("window,gram", [(10, 6), (7, 3), (12, 12)])
def test_random_texts(spark, window, gram):
    import random
    r = random.Random(window)
    pool = [r.choice("abcdefg") + r.choice("xyz") for _ in range(60)]
    items = [(i, " ".join(r.choices(pool, k=r.randint(window, 30)))) for i in range(12)]
    docs = []
    for i in range(60):
        w = r.choices(pool, k=r.randint(0, 40))
        src = r.choice(items)[1].split()
        s = r.randrange(len(src))
        w += src[s:s + r.randint(window - 3, window + 6)] + r.choices(pool, k=3)
        docs.append((i, " ".join(w)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows(contamination(d, b, window=window, gram=gram)) == brute(docs, items, window)


def test_plan_has_no_python(spark):
    from conftest import SF_SMALL
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    b = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    plan = contamination_digest(d, b)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
