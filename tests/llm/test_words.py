"""Different words that a hash by powers of one number cannot tell apart."""

import numpy as np
import pyarrow as pa
import pytest

from flowsentry.llm import textkit as T


def twins(rounds=10):
    a, b = "a", "b"
    for _ in range(rounds):
        a, b = a + b, b + a
    return a, b


def test_hashes_of_words():
    a, b = twins()
    assert len(a) == 1024
    seen = {}
    for text in (f"{a} {b} {a}", "x xx xxx  yx", a + b, "\x00 \x00\x00", "é é", None, "", " \t"):
        for w in T.word_pieces(pa.array([text])):
            for i, h in enumerate(w.hashes().tolist()):
                assert seen.setdefault(h, w.text(i)) == w.text(i)
    assert len(seen) == 3 + 4 + 2 + 2 - 0
    # the place in the buffer and the neighbours do not matter
    one = [w.hashes().tolist() for w in T.word_pieces(pa.array(["  ab   c", "c ab", "ab" + " " * 5000 + "c"]))]
    flat = [h for p in one for h in p]
    assert flat[0] == flat[3] == flat[4] and flat[1] == flat[2] == flat[5]


def test_random_words_do_not_collide():
    r = np.random.default_rng(1)
    words = {"".join(r.choice(list("ab"), r.integers(1, 40))) for _ in range(20_000)}
    got = [h for w in T.word_pieces(pa.array([" ".join(words)])) for h in w.hashes().tolist()]
    assert len(set(got)) == len(words)


@pytest.fixture()
def docs(spark):
    a, b = twins()
    return spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}")], "doc_id long, text string")


def test_no_link_between_them(docs):
    from flowsentry.llm.jaccard import jaccard_components
    assert {r.doc_id: r.component_id for r in jaccard_components(docs, k=3, percent=90).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_token_counts_of_each(docs):
    from flowsentry.llm.queries import piece_model
    from flowsentry.llm.wordpiece import matcher, token_counts
    a, b = twins()
    m = matcher(piece_model())
    want = {1: m.count(a), 2: m.count(b), 3: m.count(a) + m.count(b), 4: m.count(a) + m.count(b)}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, piece_model()).collect()} == want == {1: 428, 2: 427, 3: 855, 4: 855}


def test_two_words_of_the_language_model(spark):
    import zlib
    from flowsentry.llm.lm import score_documents
    a, b = twins()
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10][:12]
    out_id = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(i, f"{a} w{i % 3}") for i in ids] + [(out_id, b)]
    got = {r.doc_id: r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[out_id].n_known == 1 and got[ids[0]].n_known == 3  # the end alone; both words and the end


def test_repeats_need_equal_words(spark):
    from flowsentry.llm.suffixes import repeated_spans
    a, b = twins()
    tail = " ".join(f"w{i}" for i in range(60))
    rows = [(1, " ".join([a] * 55)), (2, " ".join([b] * 55)), (3, tail), (4, tail)]
    got = {r.doc_id: r.n_repeated for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one = {r.doc_id: r.n_repeated for r in repeated_spans(spark.createDataFrame(rows[:1], "doc_id long, text string")).collect()}
    assert got[1] == one[1] and got[2] == one[1] and got[4] == got[3]


def test_features_of_the_quality_model():
    from flowsentry.llm.textkit import gram_hashes
    a, b = twins()
    for w in T.word_pieces(pa.array([f"{a} {b} {a} {a}"])):
        assert len(set(gram_hashes(w.hashes(), 2).tolist())) == 3 and len(set(w.hashes().tolist())) == 2
