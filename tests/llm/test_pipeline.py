import hashlib
import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from conftest import SF_MID, SF_SMALL
from flowsentry.llm import langid, queries
from llm_helpers import words
from test_decontam import brute as leaks
from test_jaccard import brute as classes
from test_suffixes import brute as repeats


def cut(text, gone):
    """The text without the words at ``gone`` (and the space after each)."""
    spans = [m.span() for m in re.finditer("[^\x20\x09-\x0D]+", text)]
    ends = [s for s, _ in spans[1:]] + [len(text)]
    out, at = [], 0
    for i, (s, _) in enumerate(spans):
        if i in gone:
            out.append(text[at:s])
            at = ends[i]
    return "".join(out) + text[at:]


def brute(rows, items):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    root = classes(rows, 5, 80)
    rows = [r for r in rows if root[r[0]][1] == r[0]]
    rep = repeats(rows)
    kept = []
    for i, t in rows:
        gone = rep.get(i, (0, set()))[1]
        if not gone or len(gone) < len(words(t)):
            kept.append((i, cut(t, gone)))
    bad = {r[0] for r in leaks(kept, items) if r[2]}
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    out = {}
    for i, t in kept:
        if i not in bad:
            ids = sp.encode(t)
            out[i] = (len(ids), hashlib.md5(str(ids).encode()).hexdigest(), sp.decode(ids))
    return out


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_MID}/benchmark.parquet").collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()], items)
    got = {r.doc_id: (r.n_tokens, hashlib.md5(str(list(r.ids)).encode()).hexdigest(), r.text)
           for r in P.run(spark, SF_MID).collect()}
    assert got == want
    assert 0 < len(got) < docs.count()


@pytest.fixture(scope="module")
def odd(spark):
    t = " ".join(f"w{i}x" for i in range(80))
    return spark.createDataFrame(
        [(1, t, "en", "s", 1, 7), (1, t, "en", "s", 1, 7), (2, t + " end", None, None, None, 7), (3, None, "en", "s", 0, 7),
         (4, "", "en", "s", 0, 7), (None, t, "en", "s", 0, 7), (5, "12 34", "en", "s", 5, 7), (6, "word", "en", "s", 4, 7)],
        "doc_id long, text string, lang string, source string, n_chars long, component_id int")


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stage_edges(spark, odd, name):
    stage = dict(P.STAGES)[name]
    out = stage(spark, odd, SF_SMALL)
    if name != "pieces":
        assert out.dtypes == odd.dtypes
    n = {"language": 5, "near_duplicates": 5, "decontamination": 8, "pieces": 8}.get(name)
    got = out.collect()
    assert n is None or len(got) == n
    if name == "repeated_passages":
        assert {r.doc_id: r.n_chars for r in got if r.doc_id == 2} == {2: 3}
        assert len([r for r in got if r.doc_id == 1]) == 2  # repeated rows are not cut
    assert stage(spark, odd.limit(0), SF_SMALL).count() == 0


def test_language_stage_drops_only_texts_without_letters(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = P.language(spark, docs, SF_SMALL)
    want = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in out.collect()} == want and langid.UNDETERMINED == "und"


@pytest.fixture(scope="module")
def shared(spark):
    """Rows that share an id, or have none, with different texts."""
    def text(name, n):
        return " ".join(f"{name}{i}x" for i in range(n))
    leak = next(r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect() if len(words(r.text)) > 20)
    rows = [(None, leak), (None, text("clean", 30)), (7, "start " + leak), (7, text("other", 90)), (8, text("other", 70)),
            (8, "own words " + text("z", 3)), (9, text("y", 60) + " " + text("other", 60)), (9, text("v", 3)),
            (None, text("w", 5) + " " + text("other", 60)), (10, text("b", 60)), (11, text("b", 60)), (11, text("c", 60)),
            (None, text("n", 5)), (None, text("n", 5))]
    return spark.createDataFrame([(i, t, "en", "s", len(t), None) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, component_id int")


def test_shared_ids_are_judged_by_text(spark, shared):
    rows = [(r.doc_id, r.text) for r in shared.collect()]
    left = {(r.doc_id, r.text) for r in P.decontamination(spark, shared, SF_SMALL).collect()}
    assert left == {r for i, r in enumerate(rows) if i not in (0, 2)}

    got = [(r.doc_id, r.text) for r in P.near_duplicates(spark, shared, SF_SMALL).collect()]
    assert sorted(map(str, got)) == sorted(str(r) for i, r in enumerate(rows) if i not in (0, 10, 13))

    cut = {(r.doc_id, r.text) for r in P.repeated_passages(spark, shared, SF_SMALL).collect()}
    assert (8, rows[5][1]) in cut and (9, rows[7][1]) in cut and (11, rows[11][1]) in cut and rows[3] in cut
    assert (8, rows[4][1]) not in cut and (11, rows[10][1]) not in cut  # whole texts repeat
    assert (9, rows[6][1].split("other")[0]) in cut
    assert (None, rows[8][1].split("other")[0]) in cut  # a row without an id is cut as well


@pytest.mark.parametrize("lang", [None, "und"])
def test_language_stage_keeps_lettered_rows_whatever_the_labels(spark, lang):
    docs = spark.createDataFrame([(1, "some words", lang), (2, "12 34", lang), (3, None, lang), (4, "más", lang)],
                                 "doc_id long, text string, lang string")
    assert {r.doc_id for r in P.language(spark, docs, SF_SMALL).collect()} == {1, 4}


NAMES = ["_row", "_own", "_id", "_text", "_cut", "_none", "_before", "_lang_pred", "_lettered", "user", "id", "t", "th",
         "row", "own", "of", "gone", "score", "lettered", "lang_pred", "before", "component_id", "copies"]


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:4]])
def test_columns_of_any_name_pass_through(spark, shared, name):
    wide = shared.drop("component_id")
    for i, c in enumerate(NAMES):
        wide = wide.withColumn(c, F.concat(F.lit(f"{c}:"), F.substring("text", 1, 9)))
    out = dict(P.STAGES)[name](spark, wide, SF_SMALL)
    assert out.dtypes == wide.dtypes
    plain = dict(P.STAGES)[name](spark, shared, SF_SMALL)
    rows = out.collect()
    assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str((r.doc_id, r.text)) for r in plain.collect())
    before = {r.text[:9] for r in shared.collect()}
    assert rows and all(r[c].startswith(f"{c}:") and r[c][len(c) + 1:] in before for r in rows for c in NAMES)


def test_near_copies_without_an_id(spark):
    def text(*extra):
        return " ".join([*(f"w{i}" for i in range(60)), *extra])
    rows = [(None, text()), (None, text("end")), (4, text("x")), (None, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, df, SF_SMALL).collect()), key=str)
    assert got == sorted([rows[2], rows[3], rows[5]], key=str)


def test_language_stage_rejects_by_the_profiles(spark):
    """A text that has nothing in common with any learned language goes."""
    import numpy as np
    rows = [(i, " ".join(w), lang) for i, (lang, w) in enumerate(
        [("en", ["the", "house", "and", "the", "river"]), ("de", ["das", "haus", "und", "der", "fluss"])] * 5)]
    rows.append((99, "qxz " * 3, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.train_profiles(docs)
    scores = {r.doc_id: r.score for r in langid.identify(docs, profiles).collect()}
    kept = {r.doc_id for r in P.language(spark, docs, SF_SMALL).collect()}
    assert kept == {i for i, s in scores.items() if s > 0} and set(range(10)) <= kept
    assert np.isclose(min(scores.values()), 0) == (99 not in kept)


def test_language_stage_labels_what_follows(spark):
    """A missing or wrong label gives way to the language the text resembles,
    and the last stage returns it; rows stay as many as they are."""
    en, de = "the house and the river of the town", "das haus und der fluss der stadt"
    rows = [*((i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(10)), (20, en, None), (21, de, "en"),
            (None, de + " und das", None), (22, de, "de"), (22, de, "en"), (23, "12", "en"), (24, "ri", "de"), (24, "ri", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = P.language(spark, docs, SF_SMALL)
    found = langid.identify(docs.where("doc_id = 24"), langid.train_profiles(docs)).first()
    assert 0 < found.score <= P.SURE_COSINE  # too few letters to overrule a label
    want = sorted([(str(i), "en" if t == en else "de") for i, t, _ in rows if i not in (23, 24)]
                  + [("24", "de"), ("24", found.lang_pred)])
    assert sorted((str(r.doc_id), r.lang) for r in left.collect()) == want
    assert sorted((str(r.doc_id), r.lang) for r in P.token_pieces(spark, left, SF_SMALL).collect()) == want
