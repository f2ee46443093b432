"""Merkle manifest of a table: a hash tree per source and one over the sources.

Rows become leaves, sixteen consecutive nodes a run, and the hash of a run a
node of the next level.  Every level is built in Spark and stored as rows that
name their parent run.  Checking is a recursive SQL query over those rows: it
starts with the leaves, and each step meets the parent run, appends the
siblings found there and folds the (tampered or original) leaf hash with them,
up to the root.

The siblings above a run are the same for all its leaves, so the climb has one
row per lowest run with its at most sixteen leaves side by side; every leaf is
folded by itself.  A proof is thus carried once per run and written out per
leaf only where it is hashed.

The higher a run, the more rows of the climb meet it.  So its row is stored in
copies, one per ``COPY_LEAVES`` leaves below, and a climbing row meets the copy
its number picks; no step gathers a source's rows in one task.

Positions of a source's leaves are counted in sorted ranges of all rows with
one offset per range and source, so no source is gathered into one task.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsentry.llm.jaccard import stored

#: nodes of a run
FAN = 16
#: rows aimed at in one sorted range
RANGE_ROWS = 100_000
#: leaves of the whole table that meet one copy of a run
COPY_LEAVES = 4096
#: a row is tampered with where this divides the checksum of its id
TAMPER_EVERY = 5
#: the tree over the sources has this number in place of a source's
TOP = -1
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, ``:`` and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
           fields: Sequence[str] = FIELDS) -> DataFrame:
    """``row, id, src, leaf, bad``: the leaf hash of every row, and the hash of
    the row with its text in lower case where it is tampered with (else null).
    A null id is never tampered with."""
    col = {c: F.col(f"`{c}`") for c in {*fields, id_col, source, text}}
    same = [field(col[c]) for c in fields]
    other = [field(lower_ascii(col[c])) if c == text else field(col[c]) for c in fields]
    hit = F.crc32(col[id_col].cast("string").cast("binary")) % TAMPER_EVERY == 0
    rows = df.select(col[id_col].alias("id"), col[source].alias("src"), digest(*same).alias("leaf"),
                     F.when(hit, digest(*other)).alias("bad"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "manifest-leaves")


def _ranged(df: DataFrame, order: list[str], name: str, rows: int) -> DataFrame:
    """``df`` stored in sorted ranges with their number ``part``."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    return stored(df.repartitionByRange(max(8, rows // RANGE_ROWS), *keys).withColumn("part", F.spark_partition_id()), name)


def placed(rows: DataFrame) -> DataFrame:
    """``row, id, s, pos, leaf, bad`` and ``size`` (leaves of the source):
    sources numbered from 0 (null first, then bytewise), the leaves of each from
    0 by id (null first), equal ids by leaf hash."""
    n = rows.count()
    ranged = _ranged(rows, ["src", "id", "leaf", "row"], "manifest-ranges", n)
    per = stored(ranged.groupBy("src", "part").agg(F.count("*").alias("n")), "manifest-counts")
    sources = per.groupBy("src").agg(F.sum("n").alias("size"))
    m = sources.count()
    sources = _ranged(sources, ["src"], "manifest-sources", m)
    first = sources.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    sources = sources.withColumn("inside", F.row_number().over(Window.partitionBy("part").orderBy("src"))) \
        .join(first, "part").select("src", "size", (F.col("before") + F.col("inside") - 1).cast("long").alias("s"))
    # a source's number and the leaves before this range, one row per source and range
    back = Window.partitionBy("src").orderBy("part")
    per = per.withColumn("before", F.sum("n").over(back) - F.col("n"))
    both = stored(per.join(sources, per["src"].eqNullSafe(sources["src"])).select(
        "part", per["src"].alias("of"), "s", "size", "before"), "manifest-offsets")
    inside = F.row_number().over(Window.partitionBy("part", "src").orderBy("id", "leaf", "row"))
    same = (ranged["part"] == both["part"]) & ranged["src"].eqNullSafe(both["of"])
    return ranged.withColumn("inside", inside).join(both, same).select(
        "row", "id", "s", (F.col("before") + F.col("inside") - 1).alias("pos"), "size", "leaf", "bad")


def _up(s: Column, pos: Column, size: Column) -> list[Column]:
    """Tree, position and slot of a node's parent run: in its own tree, or for a
    tree's only node of a level in the tree over the sources."""
    only = size == 1
    return [F.when(only, F.lit(TOP)).otherwise(s).alias("us"),
            F.floor(F.when(only, s).otherwise(pos) / FAN).cast("long").alias("up"),
            (F.when(only, s).otherwise(pos) % FAN).cast("int").alias("slot")]


def _levels(nodes: DataFrame, level: int, name: str):
    """Stores the runs above ``nodes`` (``s, pos, size, digest, n``; ``size`` nodes
    in tree ``s``, ``n`` leaves of the table below) level by level; yields the
    run rows and the trees' tops."""
    nodes = nodes.select("s", "pos", "size", "digest", "n", F.lit(level).alias("level"))
    while True:
        yield "top", nodes.where("size = 1").select("s", "level", "digest", "n")
        runs = nodes.where("size > 1").groupBy("s", F.floor(F.col("pos") / FAN).cast("long").alias("run")).agg(
            F.max("size").alias("size"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("kids"))
        level += 1
        runs = stored(runs.select(
            "s", F.lit(level).alias("level"), F.col("run").alias("pos"), F.ceil(F.col("size") / FAN).cast("long").alias("size"),
            "n", F.sha2(F.array_join("kids.digest", ""), 256).alias("digest"), F.col("kids.digest").alias("kids")), name)
        if runs.isEmpty():
            return
        yield "runs", runs
        nodes = runs.drop("kids")


def tree(leaf_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run rows ``s, level, pos, copy, kids, digest, us, ulevel, up, slot,
    ucopies`` (the last five name the parent run, the place in it and the number
    of its copies; ``ulevel`` is null at the root) and the source tops ``s,
    level, digest, n``.

    Levels count from 0 at a source's leaves, and in the tree over the sources
    from 0 at its tops.
    """
    def collect(nodes, name):
        runs, tops = [], []
        for kind, df in _levels(nodes, 0, name):
            (runs if kind == "runs" else tops).append(df)
        return runs, tops

    def union(frames):
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    low, tops = collect(leaf_rows.select("s", "pos", "size", F.col("leaf").alias("digest"),
                                          F.lit(1).cast("long").alias("n")), "manifest-runs")
    tops = stored(union(tops), "manifest-tops")
    count = tops.count()
    high, _ = collect(tops.select(F.lit(TOP).cast("long").alias("s"), F.col("s").alias("pos"),
                                  F.lit(count).cast("long").alias("size"), "digest", "n"), "manifest-top-runs")
    if not low and not high:
        return None, tops
    rows = union(low + high)
    alone = F.col("size") == 1
    is_top = F.col("s") == TOP
    root = alone & (is_top | F.lit(count == 1))
    rows = rows.select("s", "level", "pos", "kids", "digest", *_up(F.col("s"), F.col("pos"), F.col("size")),
                       F.when(root, F.lit(None)).when(alone & ~is_top, F.lit(1)).otherwise(F.col("level") + 1).alias("ulevel"),
                       (F.col("n") / COPY_LEAVES).cast("long").alias("more"))
    rows = stored(rows, "manifest-rows")
    parent = rows.where("more > 0").select(F.col("s").alias("us"), F.col("level").alias("ulevel"), F.col("pos").alias("up"),
                                           (F.col("more") + 1).alias("ucopies"))
    rows = rows.join(parent, ["us", "ulevel", "up"], "left").withColumn("ucopies", F.coalesce("ucopies", F.lit(1).cast("long")))
    return stored(rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), "more"))).drop("more"),
                  "manifest-tree"), tops


CLIMB = """
WITH RECURSIVE climb (gid, us, ulevel, up, ucopies, slots, folds, low, above, subroot, step) AS (
  SELECT gid, us, ulevel, up, CAST(1 AS BIGINT), slots, folds, CAST(NULL AS ARRAY<STRING>), '', CAST(NULL AS STRING), 0
  FROM {start}
  UNION ALL
  SELECT c.gid, r.us, r.ulevel, r.up, r.ucopies,
    CASE WHEN r.ulevel IS NOT NULL THEN array_repeat(r.slot, size(c.folds)) END,
    transform(c.folds, (x, i) -> sha2(array_join(
      transform(r.kids, (k, j) -> CASE WHEN j = element_at(c.slots, i + 1) THEN x ELSE k END), ''), 256)),
    CASE WHEN c.step = 0 THEN r.kids ELSE c.low END,
    CASE WHEN c.step = 0 THEN '' ELSE concat(c.above, array_join(
      filter(r.kids, (k, j) -> j <> element_at(c.slots, 1)), '')) END,
    CASE WHEN r.s >= 0 AND (r.us < 0 OR r.ulevel IS NULL) THEN r.digest ELSE c.subroot END,
    c.step + 1
  FROM climb c JOIN {tree} r
    ON c.us = r.s AND c.ulevel = r.level AND c.up = r.pos AND pmod(c.gid, c.ucopies) = r.copy
)
SELECT gid, folds AS folded, low, above, subroot FROM climb WHERE ulevel IS NULL
"""


def climbed(start: DataFrame, runs: DataFrame) -> DataFrame:
    """``gid, folded, low, above, subroot``: the climb's last rows (at the root)."""
    spark = start.sparkSession
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return stored(spark.sql(CLIMB, start=start, tree=runs), "manifest-climb")
    finally:
        spark.conf.unset(ROW_LIMIT) if before is None else spark.conf.set(ROW_LIMIT, before)


def manifest(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
             fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row per row of ``df``: ``id_col, leaf, subroot, root, proof`` (the
    siblings, level by level), ``folded_root``, ``verified`` and ``tampered``.

    Null values have a leaf text of their own (``-``), so null and empty differ;
    a null source is a source, the first; a null id comes first in its source;
    rows with equal ids are ordered by their hash (equal rows are
    interchangeable).  A lone leaf is its subroot, a lone subroot the root, and
    a row that is both has an empty proof.  An empty table gives no rows.
    Columns other than ``fields`` are not read.
    """
    rows = stored(placed(leaves(df, id_col, source, text, fields)), "manifest-placed")
    runs = tree(rows)[0]
    if runs is None:  # no row, or one
        return rows.select(F.col("id").alias(id_col), "leaf", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"),
                           F.lit("").alias("proof"), F.coalesce("bad", "leaf").alias("folded_root"),
                           (F.coalesce("bad", "leaf") == F.col("leaf")).alias("verified"), F.col("bad").isNotNull().alias("tampered"))
    root = runs.where("ulevel is null and copy = 0").select(F.col("digest").alias("root"))  # one row
    start = rows.select("id", "leaf", "bad", *_up(F.col("s"), F.col("pos"), F.col("size"))) \
        .groupBy("us", "up").agg(F.array_sort(F.collect_list(F.struct(
            "slot", "id", "leaf", "bad"))).alias("mine"))
    start = stored(start.select(F.monotonically_increasing_id().alias("gid"), "us", F.lit(1).alias("ulevel"), "up", "mine"),
                   "manifest-start")
    done = climbed(start.select("gid", "us", "ulevel", "up", F.col("mine.slot").alias("slots"), F.transform(
        "mine", lambda x: F.coalesce(x["bad"], x["leaf"])).alias("folds")), runs)
    out = done.join(start.select("gid", "mine"), "gid").select(
        "low", "above", "subroot", F.explode(F.arrays_zip("mine", "folded")).alias("x"))
    kin = F.filter("low", lambda k, j: j != F.col("x.mine.slot"))
    out = out.select(F.col("x.mine.id").alias(id_col), F.col("x.mine.leaf").alias("leaf"),
                     F.coalesce("subroot", "x.mine.leaf").alias("subroot"), F.concat(F.array_join(kin, ""), "above").alias("proof"), F.col("x.folded").alias("folded_root"),
                     F.col("x.mine.bad").isNotNull().alias("tampered"))
    return out.crossJoin(F.broadcast(root)).select(id_col, "leaf", "subroot", "root", "proof", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"), "tampered")


def manifest_digest(docs: DataFrame) -> DataFrame:
    """``manifest`` with the SHA-256 of each proof in place of its text."""
    return manifest(docs).select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
                                 "folded_root", "verified")


def _sql_field(c: str) -> str:
    return f"coalesce(cast(strlen(cast({c} AS varchar)) AS varchar) || ':' || cast({c} AS varchar), '-')"


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEAD = " || ".join(_sql_field(c) for c in FIELDS[:-1])

ORACLE_SQL = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT *, CASE WHEN doc_id IS NULL THEN false ELSE xor(list_reduce(list_prepend(4294967295, list_transform(
      string_split(cast(doc_id AS varchar), ''), lambda x: cast(ascii(x) AS bigint))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 END AS hit FROM documents, crc),
lf AS (SELECT doc_id, source, sha256({_HEAD} || {_sql_field('text')}) AS leaf,
    sha256({_HEAD} || CASE WHEN hit THEN {_sql_field(_LOW)} ELSE {_sql_field('text')} END) AS cur FROM d),
pl AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS size FROM lf),
lv AS (SELECT source, 0 AS level, pos, leaf AS digest, size FROM pl
  UNION ALL
  SELECT source, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), max((size + 15) // 16)
  FROM lv WHERE size > 1 GROUP BY source, level, pos // 16),
sub AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS r,
    count(*) OVER () AS n FROM lv WHERE size = 1),
tv AS (SELECT 0 AS level, r AS pos, subroot AS digest, n AS size FROM sub
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), max((size + 15) // 16)
  FROM tv WHERE size > 1 GROUP BY level, pos // 16),
runs AS (SELECT tree, level, pos // 16 AS run, list(digest ORDER BY pos) AS kids FROM (
    SELECT r AS tree, level, pos, digest, size FROM lv JOIN sub ON lv.source IS NOT DISTINCT FROM sub.source
    UNION ALL SELECT -1, level, pos, digest, size FROM tv) x WHERE size > 1 GROUP BY ALL),
climb AS (SELECT pl.doc_id, pl.leaf, sub.subroot, sub.r AS tree, 0 AS level, pl.pos, pl.size, sub.r, sub.n, pl.cur, '' AS proof
    FROM pl JOIN sub ON pl.source IS NOT DISTINCT FROM sub.source
  UNION ALL
  SELECT doc_id, leaf, subroot, CASE WHEN c.size > 1 THEN c.tree ELSE -1 END, CASE WHEN c.size > 1 THEN c.level + 1 ELSE 0 END,
    CASE WHEN c.size > 1 THEN c.pos // 16 ELSE c.r END, CASE WHEN c.size > 1 THEN (c.size + 15) // 16 ELSE c.n END, c.r, c.n,
    CASE WHEN c.size > 1 THEN sha256(array_to_string(list_transform(kids,
      lambda k, i: CASE WHEN i = c.pos % 16 + 1 THEN c.cur ELSE k END), '')) ELSE c.cur END,
    CASE WHEN c.size > 1 THEN c.proof || array_to_string(list_filter(kids, lambda k, i: i <> c.pos % 16 + 1), '') ELSE c.proof END
  FROM climb c LEFT JOIN runs ON runs.tree = c.tree AND runs.level = c.level AND runs.run = c.pos // 16
  WHERE c.size > 1 OR c.tree <> -1)
SELECT doc_id, leaf, subroot, (SELECT digest FROM tv WHERE size = 1) AS root, sha256(proof) AS proof_sha256,
  cur AS folded_root, cur = (SELECT digest FROM tv WHERE size = 1) AS verified
FROM climb WHERE tree = -1 AND size = 1"""
