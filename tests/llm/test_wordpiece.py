import random

from conftest import SF_SMALL
from flowsentry.llm.queries import piece_model
from flowsentry.llm.wordpiece import LongestMatch, read_vocabulary, token_counts
from llm_helpers import words


def greedy(word, starts, rest):
    """Longest piece first, piece by piece; 0 where stuck."""
    n, at, vocab = 0, 0, starts
    while at < len(word) or n == 0:
        end = next((e for e in range(len(word), at - 1, -1) if word[at:e] in vocab and (e > at or not n)), None)
        if end is None:
            return 0
        n, at, vocab = n + 1, end, rest
    return n


def test_random_vocabularies():
    r = random.Random(1)
    for _ in range(60):
        def word():
            return "".join(r.choice("ab") for _ in range(r.randint(1, 6)))
        starts, rest = {word() for _ in range(8)}, {word() for _ in range(6)}
        if r.random() < 0.5:
            starts.add("")
        m = LongestMatch(sorted(starts), sorted(rest))
        for _ in range(200):
            w = "".join(r.choice("ab" if r.random() < 0.95 else "c") for _ in range(r.randint(1, 14)))
            assert m.count(w) == greedy(w, starts, rest), (w, starts, rest)


def test_table(spark):
    starts, rest = map(set, read_vocabulary(piece_model()))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r.doc_id: r for r in token_counts(docs, piece_model()).collect()}
    import re
    for r in docs.collect():
        ws = re.findall("[^\x20\x09-\x0D]+", r.text)
        n = [greedy(w, starts, rest) for w in ws]
        g = got[r.doc_id]
        assert (g.n_words, g.n_tokens, g.n_unknown) == (len(ws), sum(x or 1 for x in n), n.count(0))


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a 漢一 a", 1), (3, "a" * 50000, 1), (3, "b", 1)],
                               "doc_id long, text string, n_words int")
    out = [tuple(r) for r in token_counts(df, piece_model()).collect()]
    assert out[0] == (1, 0, 0, 0) and out[1] == (2, 0, 0, 0) and out[2][1] == 3 and out[3][1] == 1
    assert token_counts(df.limit(0), piece_model()).count() == 0
    assert words("a b") == ["a", "b"]
