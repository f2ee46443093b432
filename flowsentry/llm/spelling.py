"""Spelling variants by a dictionary of trie-node pairs.

Words are numbered in code-point order, and so are the nodes of two tries: of
the words, and of the words read backwards.  A word split at a position is a
pair of integers, the node of what is before and the node of what is after.
A word with one code point skipped is such a pair as well.  So

* two words that differ by a replaced code point share a pair with that
  position skipped;
* a word with an inserted code point shares, that position skipped, the pair
  of the other word split there.

All pairs with one skipped or no position are grouped, and only pairs with more
than one member go on.  Such a group has at most one whole word and one member
per letter, and its members are never multiplied with each other: each member
takes the group's size and its best other member.  A code point of a run of
equal ones is skipped for deletion at the first of them only, so every
neighbour is met once.

Node names are cut into blocks with a running hash, so a word of any length
costs as much as its length.  Nodes that very many words pass through (short
prefixes and endings) are looked up in a broadcast table of at most
``MOST_HEAVY`` rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.jaccard import stored
from flowsentry.llm.mixing import ranked

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: a run whose checksum this divides loses a code point (planted misspellings)
DELETE_EVERY = 199
#: code points of a block of a node's name
BLOCK = 64
#: positions of a node above which it is looked up by broadcast, and most nodes looked up so
HEAVY, MOST_HEAVY = 50_000, 100_000
#: words aimed at in one sorted range
RANGE_WORDS = 50_000


def lower_ascii(s: Column) -> Column:
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(
        F.translate(s, string.ascii_uppercase, string.ascii_lowercase))


def word_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, delete_every: int = DELETE_EVERY) -> DataFrame:
    """``word, n`` of all words frequent and long enough.  A null text has none;
    a null id is written as nothing before the colon."""
    runs = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    if delete_every:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        runs = runs.select(F.when(h % delete_every == 0, cut).otherwise(F.col("run")).alias("run"))
    return runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")) \
        .where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def trie_nodes(words: DataFrame, width: int, backwards: bool) -> DataFrame:
    """``id, at, node`` for every position 0 to length of every word (``id,
    word``): the number of the trie node of what is before (``backwards``: after)
    the position; forwards also ``first``, whether the code point there differs
    from the one before it.  A node's number is the least word id through it
    times ``width`` (over all lengths) plus its depth."""
    w = F.reverse("word") if backwards else F.col("word")
    base = words.select("id", w.alias("w"), F.length("word").alias("len"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.col("len") / BLOCK).cast("int")), lambda b: F.struct(
        (b * BLOCK).alias("start"), F.substring(F.col("w"), b * BLOCK + 1, F.lit(BLOCK)).alias("text"),
        F.when(b > 0, F.substring(F.col("w"), b * BLOCK, F.lit(1))).alias("prev")))
    base = base.select("id", "len", blocks.alias("blocks"))
    chain = F.aggregate(F.slice("blocks.text", 1, F.size("blocks") - 1), F.array(F.lit("")), lambda a, t: F.concat(
        a, F.array(F.sha2(F.concat(F.element_at(a, -1), t), 256))))
    base = base.select("id", "len", F.explode(F.arrays_zip(F.col("blocks"), chain.alias("chain"))).alias("x"))
    inside = base.select("id", "len", "x.blocks.*", "x.chain").select("*", F.explode(F.sequence(
        F.lit(0), F.least(F.lit(BLOCK - 1), F.col("len") - F.col("start")))).alias("o"))
    depth = F.col("start") + F.col("o")
    cols = ["id", depth.alias("depth"), F.concat("chain", F.substring("text", F.lit(1), F.col("o"))).alias("name")]
    if backwards:
        cols.append((F.col("len") - depth).alias("at"))
    else:
        here = F.substring("text", F.col("o") + 1, F.lit(1))
        before = F.when(F.col("o") == 0, F.col("prev")).otherwise(F.substring("text", F.col("o"), F.lit(1)))
        cols += [depth.alias("at"), F.coalesce(here != before, F.lit(True)).alias("first")]
    spots = stored(inside.select(*cols), "spelling-spots")
    nodes = stored(spots.where("depth > 0").groupBy("name").agg(F.min("id").alias("least"), F.count("*").alias("n")),
                   "spelling-nodes")
    limit = max(HEAVY, (nodes.agg(F.sum("n")).first()[0] or 0) // MOST_HEAVY)
    heavy = nodes.where(F.col("n") > limit).select("name", F.col("least").alias("known"))
    found = spots.join(F.broadcast(heavy), "name", "left")
    found = found.withColumn("known", F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.col("known")))
    light = found.where("known is null").drop("known").join(
        nodes.where(F.col("n") <= limit).select("name", F.col("least").alias("known")), "name")
    out = found.where("known is not null").unionByName(light)
    node = F.col("known") * F.lit(width).cast("long") + F.col("depth")
    return out.select("id", "at", node.alias("node"), *([] if backwards else ["first"]))


def neighbours(words: DataFrame) -> DataFrame:
    """``id, n_near, best`` of the words (``id, word, n``; ids in code-point
    order) that have a near word; ``best`` is a struct ``less`` (minus the
    largest count) and ``id`` of the best near word."""
    width = (words.agg(F.max(F.length("word"))).first()[0] or 0) + 1
    before = trie_nodes(words, width, False)
    after = trie_nodes(words, width, True)
    after = after.select("id", F.col("node").alias("suffix"), F.explode(F.array(
        F.struct("at", F.lit(True).alias("whole")),
        F.struct((F.col("at") - 1).alias("at"), F.lit(False).alias("whole")))).alias("x")).select("id", "suffix", "x.*")
    pairs = before.withColumnRenamed("node", "prefix").join(after, ["id", "at"]).join(
        words.select("id", (-F.col("n")).alias("less")), "id")
    member = F.struct("less", "id", "whole", "first")
    groups = pairs.groupBy("prefix", "suffix").agg(F.collect_list(member).alias("all")).where("size(all) > 1")
    rank = lambda x: F.struct(x["less"].alias("less"), x["id"].alias("id"))
    groups = groups.select(
        "all", F.transform(F.filter("all", lambda x: ~x["whole"]), rank).alias("skips"),
        F.transform(F.filter("all", lambda x: ~x["whole"] & x["first"]), rank).alias("firsts"),
        F.get(F.transform(F.filter("all", lambda x: x["whole"]), rank), F.lit(0)).alias("word"))
    groups = groups.withColumn("top", F.array_min("skips"))
    groups = groups.withColumn("second", F.array_min(F.filter("skips", lambda x: x["id"] != F.col("top.id"))))
    each = groups.select("skips", "firsts", "word", "top", "second", F.explode("all").alias("me"))
    shorter = F.when(F.col("me.first"), F.col("word"))
    others = F.when(F.col("me.id") == F.col("top.id"), F.col("second")).otherwise(F.col("top"))
    each = each.select(
        F.col("me.id").alias("id"),
        F.when(F.col("me.whole"), F.size("firsts")).otherwise(
            F.size("skips") - 1 + shorter.isNotNull().cast("int")).alias("near"),
        F.when(F.col("me.whole"), F.array_min("firsts")).otherwise(F.least(shorter, others)).alias("best"))
    return each.where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct words with counts
    (``word, n``).

    Near words differ by exactly one inserted, deleted or replaced code point.
    ``form`` is the near word with the largest count (ties: the smallest by code
    point) if that is at least ``ratio`` times the word's own, else null;
    ``root`` ends the chain of forms, which cannot loop as counts grow.  No words
    give no rows.
    """
    words = stored(counts, "spelling-words")
    words = stored(ranked(words, "word", "id", words.count(), RANGE_WORDS), "spelling-ids")
    known = stored(words.join(neighbours(words), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= F.col("n") * ratio, F.col("best")).alias("best")), "spelling-near")
    links = stored(known.where("best is not null").select("id", F.col("best.id").alias("form_id"),
                                                          F.col("best.id").alias("up")), "spelling-links")
    while True:  # every round doubles the steps looked ahead
        on = links.select(F.col("id").alias("of"), F.col("up").alias("further"))
        step = stored(links.join(on, F.col("up") == F.col("of"), "left").select(
            "id", "form_id", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")),
            "spelling-links")
        links = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    name = lambda c: words.select(F.col("id").alias(f"{c}_of"), F.col("word").alias(c))
    named = links.join(name("form"), F.col("form_id") == F.col("form_of")).join(
        name("root"), F.col("up") == F.col("root_of")).select("id", "form", "root")
    return known.join(named, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
        F.when(F.col("form").isNotNull(), -F.col("best.less")).alias("form_n"))


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of the words of all texts, planted misspellings included."""
    return variants(word_counts(df, id_col, text))


ORACLE_SQL = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
o AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (
  SELECT coalesce(cast(doc_id AS varchar), '') AS id,
    unnest(regexp_extract_all(coalesce(text, ''), '[{LETTERS}]{{{LEAST_LENGTH},}}')) AS run FROM documents) x),
g AS (SELECT id, run, hex(encode(id || ':' || run)) AS x, count(*) AS n FROM o GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x) // 2 + 1),
    lambda i: cast('0x' || substr(x, cast(2 * i - 1 AS int), 2) AS bigint))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM g, crc),
w AS (SELECT word, cast(sum(n) AS bigint) AS n FROM (SELECT n, CASE WHEN h % {DELETE_EVERY} = 0
      THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) x
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS v, i
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w) x),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM cut a JOIN w ON a.v = w.word
  UNION SELECT w.word, a.word, a.n FROM cut a JOIN w ON a.v = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * w.n THEN other END AS form,
    CASE WHEN m >= {RATIO} * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
up AS (SELECT word, word AS at_word, form FROM f
  UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON up.form = f.word)
SELECT f.word, f.form, up.at_word AS root, f.n, f.n_near, f.form_n
FROM f JOIN up ON f.word = up.word AND up.form IS NULL"""
