"""Mixing sources to target weights by weighted fair queueing, in DataFrame
functions only.

Every source has a target, its share of the budget by weight, at most
``passes`` times its size.  A pass over a source is its rows in a shuffled
order (a hash of the id and the pass).  A row's virtual finish time is the
number of its source's tokens up to and with the row, all earlier passes
included, divided by the target, so every source is through with its target at
time 1.  All rows of all passes are sorted by finish time, and the mix is that
queue up to the budget.

Both running sums (per source, and over the whole queue) are cut into ranges of
the order with one offset each, so a source that holds a third of all rows is
dealt over many tasks.  Only sums reach the driver.

Order and sums are integers or quotients of two integers, so that a rerun gives
the same mix whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsentry.llm.jaccard import stored
from flowsentry.operators.prefix import running_aggregate

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, PASSES = (3, 1, 2), (3, 2), 2
#: least rows aimed at in one range of a running sum (see ``ranges``)
RANGE_ROWS = 2_000
#: hexadecimal digits of the shuffle key
DIGITS = 15
#: order of the queue
ORDER = ["finish", "rank", "turn", "key", "id", "size"]


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(id_col: Column, turn: Column) -> Column:
    """Hash of an id (null is written ``-``) and the number of the pass."""
    name = F.concat(turn.cast("string"), F.lit(":"), F.coalesce(id_col.cast("string"), F.lit("-")))
    return F.conv(F.substring(F.md5(name), 1, DIGITS), 16, 10).cast("long")


def ranges(rows: Column) -> Column:
    """Number of ranges for so many rows: as many as rows in each, so that both
    a range and the table of offsets stay small."""
    return 1 + F.floor(rows / F.greatest(F.lit(float(RANGE_ROWS)), F.sqrt(rows)))


def ranked(df: DataFrame, col: str, out: str, rows: int, per: int = RANGE_ROWS) -> DataFrame:
    """``df`` (one row per value of ``col``) with ``out``, the rank of the value
    from 0 by code point, null last.  Ranks are counted per sorted range of about
    ``per`` rows."""
    parts = stored(df.repartitionByRange(1 + rows // per, F.col(col).asc_nulls_last())
                   .withColumn("range_no", F.spark_partition_id()), "mix-ranks")
    first = parts.groupBy("range_no").agg(F.count("*").alias("n")).select(
        F.col("range_no").alias("no"), (F.sum("n").over(Window.orderBy("range_no")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range_no").orderBy(F.col(col).asc_nulls_last()))
    return parts.withColumn("inside", inside).join(first, F.col("range_no") == F.col("no")).withColumn(
        out, F.col("before") + F.col("inside") - 1).drop("range_no", "no", "before", "inside")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE,
            passes: int = PASSES) -> DataFrame:
    """``src, source_size, n_rows, rank, target`` from one row per source
    (``src, source_size, n_rows``).

    Sources by code point, null last, have the weights in turn.  ``share`` is the
    budget as a fraction of all sizes.  A source whose share is above ``passes``
    times its size gets that, and the rest goes to the others by weight, until
    none is above; each round is one sum over the sources, and a source once
    full stays full.  All integers but the last quotient.
    """
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    out = ranked(sizes, "src", "rank", n)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    out = stored(out.withColumn("weight", weight), "mix-sources")
    up, low = (int(x) for x in share)
    # all amounts times ``low``, so that the budget is a whole number
    most, budget = F.col("source_size") * (passes * low), total * up
    full, left, heavy = F.lit(False), None, None
    while True:
        used, open_weight = out.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0)),
                                    F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if (used, open_weight) == (left, heavy):
            break
        left, heavy = used, open_weight
        # share above the bound: weight * (budget - used) / open_weight > most, in whole numbers
        full = full | (F.col("weight").cast("decimal(38,0)") * F.lit(budget - used).cast("decimal(38,0)")
                       > most.cast("decimal(38,0)") * F.lit(open_weight).cast("decimal(38,0)"))
    even = (F.col("weight") * F.lit(budget - left)).cast("double") / F.lit(float(low * max(heavy, 1)))
    return out.withColumn("target", F.when(full, (F.col("source_size") * passes).cast("double")).otherwise(even)) \
        .drop("weight")


def numbered(df: DataFrame, id_col: str, source: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """``row`` (a number), ``id, src, size`` and ``kept``, a struct of the
    ``keep`` columns, of every row of ``df``; stored, so that numbers stay."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("boolean")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").alias("src"),
                     word_count(F.col(f"`{text}`")).alias("size"), kept.alias("kept"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")


def queue(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE,
          passes: int = PASSES) -> DataFrame:
    """The whole queue of ``numbered`` rows, one entry per row and pass: ``row,
    id, rank, size, source_size, target, turn, key, finish``, ``at`` (tokens of
    the queue up to and with this entry) and ``within`` (before the budget ends;
    rows are whole, and none comes after the first that does not fit)."""
    sizes = stored(rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), "mix-sizes")
    goal = stored(targets(sizes, weights, share, passes), "mix-targets")
    total, n = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    dealt = rows.join(goal, rows["src"].eqNullSafe(goal["src"])).select(
        "row", "id", "rank", "size", "source_size", "n_rows", "target",
        F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("turn"))
    dealt = dealt.withColumn("key", shuffle_key(F.col("id"), F.col("turn")))
    # a source's ranges: the passes in turn, in each pass equal ranges of the hash
    width = ranges(F.col("n_rows"))
    part = F.col("turn") * width + F.floor(F.col("key") / F.lit(float(16 ** DIGITS)) * width)
    line = running_aggregate(dealt, ["rank"], ["turn", "key", "id", "size"], "size", "done", bucket=part)
    line = stored(line.withColumn("finish", F.coalesce(F.try_divide("done", "target"), F.lit(0.0))).drop("n_rows"), "mix-line")
    # the queue's ranges: finish times crowd up to 1 and thin out above
    cells = ranges(F.lit(n * passes))
    line = running_aggregate(line, [], ORDER, "size", "at",
                             bucket=F.floor(F.col("finish") / (F.col("finish") + 1) * cells))
    return line.withColumn("within", F.col("at") * int(share[1]) <= F.lit(total * int(share[0])))


def mix(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
        weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, passes: int = PASSES) -> DataFrame:
    """The mix itself: rows of ``df`` with all their columns in one struct
    ``row``, plus ``turn``, ``finish`` and ``at``, in queue order (a global range
    sort; a row taken twice comes twice).  Rows without tokens are not in it."""
    rows = numbered(df, id_col, source, text, df.columns)
    line = queue(rows.drop("kept"), weights, share, passes).where(F.col("within") & (F.col("size") > 0))
    return line.join(rows.select("row", "kept"), "row").orderBy(*ORDER).select(
        F.col("kept").alias("row"), "turn", "finish", "at")


def taken(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
          weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per row of ``df``: ``id_col, size, source_size, target, taken``.

    A null or empty text has size 0 and is never taken; a null source is a
    source of its own, the last; rows with equal ids are taken each by itself
    (equal rows are interchangeable); a source without words has target 0.  An
    empty table gives no rows.  Other columns are not read.
    """
    line = queue(numbered(df, id_col, source, text), weights, share, passes)
    return line.groupBy("row").agg(
        F.first("id").alias("id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.sum(F.when(F.col("within"), F.col("size")).otherwise(F.lit(0))).alias("taken")) \
        .select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


ORACLE_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''),
    '[^\x20\x09-\x0D]+')) AS bigint) AS size FROM documents),
s AS (SELECT source, cast(sum(size) AS bigint) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][r % 3 + 1] AS weight FROM (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS r FROM s) x),
-- rounds of sharing: the sources that are full, what they use, the open weight
fill AS (SELECT 0 AS round, cast([] AS bigint[]) AS filled, cast(0 AS bigint) AS used,
    (SELECT cast(sum(weight) AS bigint) FROM w) AS open
  UNION ALL
  SELECT round + 1, nf, (SELECT cast(coalesce(sum(4 * source_size), 0) AS bigint) FROM w WHERE list_contains(nf, r)),
    (SELECT cast(coalesce(sum(weight), 0) AS bigint) FROM w WHERE NOT list_contains(nf, r))
  FROM (SELECT round, filled, (SELECT list(r ORDER BY r) FROM w WHERE list_contains(f.filled, r)
      OR weight * ((SELECT 3 * sum(source_size) FROM w) - f.used) > 4 * source_size * f.open) AS nf
    FROM fill f) g WHERE len(nf) > len(filled)),
last AS (SELECT * FROM fill ORDER BY round DESC LIMIT 1),
t AS (SELECT w.source, w.r, source_size, CASE WHEN list_contains(filled, r) THEN cast(2 * source_size AS double)
    ELSE cast(weight * ((SELECT 3 * sum(source_size) FROM w) - used) AS double) / cast(2 * open AS double) END AS target
  FROM w, last),
e AS (SELECT d.doc_id, d.size, t.r, t.source_size, t.target, turn,
    substr(md5(turn || ':' || coalesce(cast(d.doc_id AS varchar), '-')), 1, 15) AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (1), (2)) v(turn)),
f AS (SELECT *, sum(size) OVER (PARTITION BY r ORDER BY turn, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS done FROM e),
q AS (SELECT *, sum(size) OVER (ORDER BY coalesce(cast(done AS double) / nullif(target, 0), 0), r, turn, key, doc_id, size
    ROWS UNBOUNDED PRECEDING) AS upto FROM f)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  cast(sum(CASE WHEN upto * 2 <= (SELECT 3 * sum(size) FROM d) THEN size ELSE 0 END) AS bigint) AS taken
FROM q GROUP BY doc_id"""
