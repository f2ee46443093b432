import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SF_MID
from flowsentry.llm import langid


def plain(text):
    """Sum of trigram vectors, letter by letter."""
    table = langid.symbol_table()
    low = text.lower() if len(text.lower()) == len(text) else text
    sym = [0]
    for c in low:
        s = int(table[ord(c)])
        if s or sym[-1]:
            sym.append(s)
    if sym[-1]:
        sym.append(0)
    a, b, c = (m.astype(int) for m in langid.letter_vectors())
    v = np.zeros(langid.DIMENSIONS)
    for x, y, z in zip(sym, sym[1:], sym[2:]):
        if y:
            v += a[x] * b[y] * c[z]
    return v


def test_bundles_equal_letter_by_letter(spark):
    texts = ["Der Hund, die Katze!", "", None, "été ÉTÉ\nñu", "漢字 kana", "a", "x" * 3000, "1 2 3", "\U0001F600 ok"]
    rows = {}
    for i, n, row, tri, cnt, has in langid.trigram_counts(pa.array(texts), 40):
        for r in range(n):
            k = row == r
            rows[i + r] = (cnt[k] @ langid.trigram_vectors(tri[k], langid.DIMENSIONS).astype(float)
                           if k.any() else np.zeros(langid.DIMENSIONS)), bool(has[r])
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        v = plain(t or "")
        assert np.allclose(rows[i][0], v), t
        assert rows[i][1] == bool(np.any(v))


def test_held_out_accuracy_and_cosine(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    out = langid.language_of(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").cache()
    assert out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    split = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    profiles = langid.train_profiles(docs.where(~split))
    for r in out.limit(25).collect():
        v = plain(r.text)
        cos = {k: v @ p / np.linalg.norm(v) for k, p in profiles.items()}
        best = max(sorted(cos), key=cos.get)
        assert r.lang_pred == best and abs(r.score - cos[best]) < 1e-3


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "de"), (4, "hello there", None), (5, "hello there", "en"),
            (5, "hello there", "en"), (None, "bonjour à tous", "fr")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    profiles = langid.train_profiles(df)
    assert sorted(profiles) == ["en", "fr"]
    out = [(r.lang_pred, r.score) for r in langid.identify(df, profiles).collect()]
    assert [p for p, _ in out] == ["und", "und", "und", "en", "en", "en", "fr"]
    assert all(0 <= s <= 1 for _, s in out) and out[0][1] == 0
    assert langid.identify(df.limit(0), profiles).count() == 0
    empty = langid.train_profiles(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}
    assert langid.language_of(df).count() == len(rows)


def test_a_row_does_not_depend_on_its_neighbours():
    import pyarrow as pa

    def symbols(texts, at):
        (_, _, row, tri, n, _), = langid.trigram_counts(pa.array(texts))
        return dict(zip(tri[row == at].tolist(), n[row == at].tolist()))
    for text in ("ÉTÉ À LA PLAGE", "МОСКВА", "ΑΘΗΝΑ", "İZMİR"):
        alone = symbols([text], 0)
        assert alone == symbols([text, "\u0130"], 0) == symbols(["\u0130", text], 1)
        if "\u0130" not in text:
            assert alone == symbols([text.lower()], 0)
