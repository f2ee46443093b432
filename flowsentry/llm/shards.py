"""Sharding by minimax contiguous partition.

Rows with equal text are one atomic group.  Groups have a fixed order (by
text hash; within each of the 4096 leading hash ranges, groups that hold a
large part of all bytes come last).  The shard capacity is the smallest one
for which greedy filling in that order needs no more than the given number of
shards; the order is cut where greedy filling cuts.

The binary search runs on size totals of hash ranges.  A range's total can be
cut anywhere at best and nowhere at worst, which bounds the capacity from
below and above; only ranges in which a cut may fall are split further (one
aggregate over the groups a round), until both bounds agree.  So the driver
holds a few ten thousand totals however many groups there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsentry.llm.jaccard import stored

#: bits of the first ranges and of every further split
TOP, SPLIT, KEY_BITS = 12, 6, 60
#: a group with at least 1 / (HEAVY * shards) of all bytes is placed by itself
HEAVY = 64
LOW = KEY_BITS - TOP
EXTRA_BYTES = 8


def sized_rows(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, size, text_crc32, grp`` and the 60-bit order key ``k``.  A null
    text has no bytes, checksum 0, and a group of its own."""
    t = F.col(text)
    grp = F.coalesce(F.md5(t.cast("binary")), F.lit("null"))
    return df.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(t), F.lit(0)) + EXTRA_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), grp.alias("grp"),
        F.coalesce(F.conv(F.substring(F.md5(t.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long"),
                   F.lit(0)).alias("k"))


class Ranges:
    """Consecutive order ranges: ``start`` code, total size, number of groups,
    and whether the range is cut no further."""

    def __init__(self, start, bits, size, count):
        order = np.argsort(start, kind="stable")
        self.start, self.bits = start[order], bits[order]
        self.size, self.count = size[order], count[order]
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size

    @property
    def whole(self):
        return (self.count <= 1) | (self.bits == 0)

    def cuts(self, capacity: int, shards: int, loose: bool) -> list[int] | None:
        """Byte positions where greedy filling cuts; None if it needs more
        shards.  Loose: ranges may be cut anywhere, else only between them."""
        at, total, out = 0, int(self.end[-1]), []
        whole = self.whole
        for _ in range(shards):
            to = at + capacity
            if to >= total:
                return out
            i = int(np.searchsorted(self.end, to, side="right"))  # the range that holds byte ``to``
            if not loose or whole[i]:
                to = int(self.begin[i])
                if to <= at:
                    return None
            out.append(to)
            at = to
        return None

    def least(self, shards: int, loose: bool, low: int) -> int:
        high = int(self.end[-1])
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, loose) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def reach(self, capacity: int, shards: int, loose: bool) -> list[int]:
        """Positions of all cuts, ending where filling gets stuck."""
        at, out, whole = 0, [], self.whole
        for _ in range(shards - 1):
            to = at + capacity
            if to >= int(self.end[-1]):
                to = int(self.end[-1])
            else:
                i = int(np.searchsorted(self.end, to, side="right"))
                if not loose or whole[i]:
                    to = max(at, int(self.begin[i]))
            out.append(to)
            at = to
        return out


def _code(k, heavy):
    """Order code of a group: leading range, heavy or not, rest of the key."""
    return F.shiftleft(F.shiftright(k, LOW), LOW + 1) + F.when(heavy, F.lit(1 << LOW)).otherwise(F.lit(0)) \
        + k.bitwiseAND((1 << LOW) - 1)


def minimax_cuts(groups: DataFrame, shards: int, largest: int) -> tuple[int, list[int]]:
    """Smallest capacity and the codes at which shards 1.. start.

    ``groups``: ``code, size``, one row per group; heavy groups carry the
    heavy bit.
    """
    def totals(ranges: DataFrame, bits: int):
        """Sizes of the groups by range of ``2 ** bits`` codes; heavy groups one by one."""
        heavy = F.col("code").bitwiseAND(1 << LOW) != 0
        cell = F.when(heavy, F.col("code")).otherwise(F.shiftright("code", bits) * F.lit(1 << bits))
        rows = ranges.groupBy(cell.alias("c"), heavy.alias("h")).agg(
            F.sum("size").alias("s"), F.count("*").alias("n")).collect()
        return (np.array([r["c"] for r in rows], np.int64), np.array([0 if r["h"] else bits for r in rows]),
                np.array([r["s"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64))

    r = Ranges(*totals(groups, LOW))
    while True:
        low = max(largest, r.least(shards, True, -(-int(r.end[-1]) // shards)))
        high = r.least(shards, False, low)
        if low == high:
            cuts = r.cuts(high, shards, False)
            return high, [int(r.start[np.searchsorted(r.begin, c)]) for c in cuts]
        split = np.zeros(len(r.size), bool)
        for a, b in zip(r.reach(low, shards, False), r.reach(high, shards, True)):
            i, j = np.searchsorted(r.end, [min(a, b), max(a, b)], side="right")
            split[max(0, i - 1):j + 2] = True
        split &= ~r.whole
        if not split.any():  # bounds differ only by ranges that no cut can reach
            split = ~r.whole
        # every range that is split has the same width within one round
        width = int(r.bits[split].max())
        split &= r.bits == width
        picked = groups.where(F.col("code").bitwiseAND(1 << LOW) == 0).join(
            F.broadcast(groups.sparkSession.createDataFrame([(int(x),) for x in r.start[split]], "cell long")),
            F.shiftright("code", width) * F.lit(1 << width) == F.col("cell"), "left_semi")
        new = totals(picked, max(0, width - SPLIT))
        r = Ranges(*(np.concatenate([old[~split], x]) for old, x in zip((r.start, r.bits, r.size, r.count), new)))


def shard_rows(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` for every row.

    ``size`` is the text's UTF-8 bytes plus 8; equal texts share a shard;
    ``slot`` numbers the rows of a shard from 0 without gaps.  Null texts are
    one group of size 8 rows, apart from empty texts.  With fewer groups than
    shards, or one group larger than an even share, some shards may be empty.
    An empty table gives no rows.  Other columns are not read.
    """
    rows = stored(sized_rows(df, id_col, text), "shard-rows")
    groups = stored(rows.groupBy("grp", "k").agg(F.sum("size").alias("size")), "shard-groups")
    n, total, largest = groups.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    if not n:
        return rows.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(0).alias("shard"),
                           F.lit(0).cast("long").alias("slot"))
    # at most HEAVY * shards groups can be heavy
    heavy = groups.where(F.col("size") * (HEAVY * shards) >= total).select("grp", F.lit(True).alias("heavy"))
    coded = groups.join(F.broadcast(heavy), "grp", "left").select(
        _code(F.col("k"), F.coalesce("heavy", F.lit(False))).alias("code"), "size")
    _, cuts = minimax_cuts(coded, shards, int(largest))
    placed = rows.join(F.broadcast(heavy), "grp", "left")
    code = _code(F.col("k"), F.coalesce("heavy", F.lit(False)))
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (code >= F.lit(c)).cast("int")
    # numbering in parts of bounded size: offset of the part + number within it
    count = rows.count()
    parts = 64 + count // (shards * 50_000)
    placed = stored(placed.select("id", "size", "text_crc32", "grp", shard.alias("shard"),
                                  F.pmod(F.xxhash64("id", "grp"), F.lit(parts)).cast("int").alias("part")), "shard-placed")
    offsets = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "grp"))
    return placed.withColumn("number", number).join(offsets, ["shard", "part"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("before") + F.col("number") - 1).alias("slot"))


def sharded_documents(docs: DataFrame) -> DataFrame:
    return shard_rows(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
