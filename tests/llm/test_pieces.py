import random

import pytest
import sentencepiece

from conftest import SF_SMALL
from flowsentry.llm.pieces import PieceCodec, Surfaces, decode_pieces, encode_pieces, piece_digest
from flowsentry.llm.queries import piece_model


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(piece_model())


@pytest.mark.parametrize("alphabet", [
    "   aabcdetinghe\n\t.,▁é漢字😀\x00ABC19'", "ab ", " ", "the in ing", "01 23.-", "\U0001F600́‍ñß ",
])
def test_random_strings_equal_the_library(sp, codec, alphabet):
    r = random.Random(alphabet)
    for _ in range(1500):
        s = "".join(r.choice(alphabet) for _ in range(r.randint(0, 70)))
        ids = sp.encode(s)
        assert codec.encode(s).tolist() == ids, s
        assert codec.decode(ids) == sp.decode(ids), s


@pytest.mark.parametrize("text", ["a" * 20000, " " * 5000 + "x", "the" * 5000, "<s></s><unk><0x41>", "\x00", "漢" * 3000])
def test_long_and_odd_texts(sp, codec, text):
    ids = sp.encode(text)
    assert codec.encode(text).tolist() == ids and codec.decode(ids) == sp.decode(ids)


def test_memo_bounds_change_nothing(sp, monkeypatch):
    from flowsentry.llm import pieces
    monkeypatch.setattr(pieces, "MEMO_CHUNKS", 3)
    monkeypatch.setattr(pieces, "MEMO_PAIRS", 2)
    c = PieceCodec(piece_model())
    s = "one two three one two four five six one " * 20
    assert c.encode(s).tolist() == sp.encode(s)


def test_frequent_chunks_outlive_a_full_memo(sp, monkeypatch):
    from flowsentry.llm import pieces
    monkeypatch.setattr(pieces, "MEMO_CHUNKS", 40)
    c, met = PieceCodec(piece_model()), []
    inner = c._segment
    monkeypatch.setattr(c, "_segment", lambda s: met.append(s) or inner(s))
    s = " ".join(f"often rare{i}" for i in range(300))
    assert c.encode(s).tolist() == sp.encode(s)
    assert sum(x.endswith("often") for x in met) == 1
    assert len(c.memo) + len(c.memo.old) <= 40
    c.memo.empty()
    assert not c.memo and not c.memo.old


def test_decoding_builds_no_encoder(sp):
    s = Surfaces(piece_model())
    assert not hasattr(s, "auto")
    for t in ("one two  three", "", " x", "\x00漢字😀", "<s>"):
        assert s.decode(sp.encode(t)) == t == sp.decode(sp.encode(t))


def test_table_digest(spark, sp):
    import hashlib
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(40).cache()
    got = {r.doc_id: r for r in piece_digest(docs, piece_model()).collect()}
    for r in docs.collect():
        ids = sp.encode(r.text)
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_edges(spark, sp):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x y", None), (None, "x y", "c"), (3, "x y", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_pieces(df, piece_model())
    assert sorted(out.columns) == ["doc_id", "ids", "text"]
    want = sp.encode("x y")
    assert [r.ids for r in out.collect()] == [[], [], want, want, want]
    back = decode_pieces(out, piece_model()).collect()
    assert [r.decoded for r in back] == ["", "", "x y", "x y", "x y"]
    assert piece_digest(df.limit(0), piece_model()).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert decode_pieces(none, piece_model()).first().decoded == ""
