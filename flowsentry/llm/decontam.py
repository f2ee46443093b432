"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``window`` consecutive words of an item (a shorter item is one
window).  Every window stands for the smallest hash of its ``gram``-word
grams; a text keeps the distinct minima of its windows as fingerprints, so a
text and an item that share a window share its fingerprint.  Fingerprints are
joined, and hits are extended: the windows behind a common fingerprint are
compared word for word, and the words inside equal windows are hit.

Items shorter than a window are too short for the winnowing guarantee; for
each of their lengths (at most ``window - 1``) all runs of that many words
are fingerprints.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.jaccard import stored

WINDOW, GRAM = 10, 6
#: bytes that end a word once A-Z are lower-cased
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: rows up to which the item side is broadcast (a hash, or a window's text of some hundred bytes)
BROADCAST_PRINTS = 500_000


def word_list(text: Column) -> Column:
    """Words of a text; null has none."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)) \
        .otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATORS), "")


def _shift(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(n + 1), F.size(a))


def _ladder(a: Column, n: int, join) -> Column:
    """Combines each element with the n - 1 after it, doubling the reach.
    The last n - 1 results cover less (there is nothing after them)."""
    reach, out = 1, a
    while reach * 2 <= n:
        out, reach = F.zip_with(out, _shift(out, reach), join), reach * 2
    if reach < n:  # overlapping or adjacent remainder
        rest = n - reach
        if join is _least:
            out = F.zip_with(out, _shift(out, rest), join)
        else:
            out = F.zip_with(out, _shift(_ladder(a, rest, join), reach), join)
    return out


def _least(x, y):
    return F.least(x, y)


def _chain(x, y):
    return F.xxhash64(x, y)


def with_prints(df: DataFrame, text: str, window: int, gram: int) -> DataFrame:
    """``df`` plus ``words`` and ``prints``: the fingerprint of every window
    start (elements past the last full window are not used)."""
    df = df.withColumn("words", word_list(F.col(text)))
    df = df.withColumn("prints", F.transform("words", lambda x: F.xxhash64(x)))
    df = df.withColumn("prints", _ladder(F.col("prints"), gram, _chain))
    return df.withColumn("prints", _ladder(F.col("prints"), window - gram + 1, _least))


def _windows(length) -> Column:
    """Structs ``(s, win)`` of all runs of ``length`` words."""
    last = F.size("words") - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(
        s.alias("s"), F.array_join(F.slice("words", s + 1, F.lit(length)), " ").alias("win")))


def _item_windows(items: DataFrame, item_id: str, text: str, window: int, gram: int) -> DataFrame:
    """Distinct ``(print, win, size, item)``; print is null for short items."""
    base = with_prints(items.select(F.col(item_id).alias("item"), F.col(text).alias("t")), "t", window, gram) \
        .where("item is not null and size(words) > 0")
    n = F.size("words")
    long = base.where(n >= window).select("item", "prints", F.explode(_windows(window)).alias("x")).select(
        F.element_at("prints", F.col("x.s") + 1).alias("print"), F.col("x.win").alias("win"),
        F.lit(window).alias("size"), "item")
    short = base.where(n < window).select(
        F.lit(None).cast("long").alias("print"), F.array_join("words", " ").alias("win"), n.alias("size"), "item")
    return long.unionByName(short).distinct()


def _sized(df: DataFrame) -> DataFrame:
    """The item side, broadcast only below a checked number of rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_PRINTS else df


def _judged(docs: DataFrame, items: DataFrame, id_col: str, text: str, item_id: str, item_text: str, window: int,
            gram: int) -> DataFrame:
    """One row per distinct id and text of ``docs``: ``id``, ``th`` (hash of
    the text), ``n_words``, ``copies``, ``hits`` and ``items``."""
    mine = F.xxhash64(F.col(text))
    base = docs.select(F.col(id_col).alias("id"), mine.alias("th"), F.col(text).alias("t"))
    wins = stored(_item_windows(items, item_id, item_text, window, gram), "decon-items")
    prints = wins.where("print is not null").select("print").distinct()
    sizes = sorted(r[0] for r in wins.where("print is null").select("size").distinct().collect())

    marked = with_prints(base, "t", window, gram)
    n = F.size("words")
    found = marked.select("id", "th", n.alias("n_words"), F.posexplode_outer(
        F.array_distinct(F.slice("prints", F.lit(1), F.greatest(n - (window - 1), F.lit(0))))).alias("at", "print"))
    found = stored(found.join(_sized(prints.withColumn("known", F.lit(True))), "print", "left")
                   .groupBy("id", "th", "n_words").agg(
                       F.coalesce(F.bool_or("known"), F.lit(False)).alias("cand"),
                       F.sum((F.coalesce("at", F.lit(0)) == 0).cast("int")).alias("copies")), "decon-found")

    cand = found.where("cand").select("id", "th")
    few = cand.count() <= BROADCAST_PRINTS
    same = base["id"].eqNullSafe(cand["id"]) & base["th"].eqNullSafe(cand["th"])
    texts = base.join(F.broadcast(cand) if few else cand, same, "left_semi")
    runs = with_prints(texts, "t", window, gram).select(
        "id", "th", "prints", F.explode(_windows(window)).alias("x"))
    runs = runs.select("id", "th", F.col("x.s").alias("s"), F.element_at("prints", F.col("x.s") + 1).alias("print"),
                       F.col("x.win").alias("win"), F.lit(window).alias("size"))
    equal = runs.join(_sized(wins.where("print is not null")), ["print", "win", "size"])
    hits = equal.select("id", "th", "s", "size", "item")
    if sizes:  # runs of all lengths of short items, in one pass over the texts
        def sized(k: int) -> Column:
            return F.transform(_windows(k), lambda x: F.struct(x["s"].alias("s"), x["win"].alias("win"), F.lit(k).alias("size")))
        part = base.select("id", "th", word_list(F.col("t")).alias("words")) \
            .select("id", "th", F.explode(F.flatten(F.array(*[sized(k) for k in sizes]))).alias("x")).select("id", "th", "x.*")
        short = wins.where(F.col("print").isNull()).select("win", "size", "item")
        hits = hits.unionByName(part.join(_sized(short), ["win", "size"]).select("id", "th", "s", "size", "item"))
    per = hits.groupBy("id", "th").agg(
        F.collect_set(F.struct("s", "size")).alias("hits"),
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    both = found["id"].eqNullSafe(per["id"]) & found["th"].eqNullSafe(per["th"])
    return found.join(per, both, "left").select(
        found["id"], found["th"], "n_words", "copies",
        F.coalesce("hits", F.array().cast("array<struct<s:int,size:int>>")).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_words``, ``hits`` (distinct
    structs ``s, size`` of equal windows) and ``items`` (ids, sorted as text).

    Null and empty texts have no words; null and empty items match nothing; no
    items or no documents give empty lists or no rows.  Rows are matched by id
    and text, so repeated rows and repeated ids are each judged on their own
    text, a null id included.
    """
    out = _judged(docs, items, id_col, text, item_id, item_text, window, gram).select(
        F.col("id").alias(id_col), "n_words", "copies", "hits", "items")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The counts of ``contamination`` and the SHA-256 of its item list."""
    hit_words = F.array_distinct(F.flatten(F.transform(
        "hits", lambda x: F.sequence(x["s"], x["s"] + x["size"] - 1))))
    return contamination(docs, items).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(hit_words).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of an item.  A row is known
    by its id (null or not) and its text."""
    bad = _judged(docs, items, id_col, text, "item_id", "text", WINDOW, GRAM).where(F.size("hits") > 0)
    marked = stored(bad.select(F.col("id").alias("_bad"), F.col("th").alias("_bad_text")), "decon-bad")
    few = marked.count() <= BROADCAST_PRINTS
    same = docs[id_col].eqNullSafe(marked["_bad"]) & (F.xxhash64(docs[text]) == marked["_bad_text"])
    return docs.join(F.broadcast(marked) if few else marked, same, "left_anti")


_SPLIT = r"""[x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']"""

ORACLE_SQL = f"""WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size,
         array_to_string(w[s : s + least(len(w), {WINDOW}) - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0) x),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, s, size, array_to_string(w[s : s + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size) x),
hit AS (SELECT doc_id, s, size, item_id FROM dw JOIN bw USING (win, size)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
         SELECT doc_id, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT doc_id, s, size FROM hit) h) q GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS i FROM hit) h GROUP BY 1)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit,
  cast(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""
