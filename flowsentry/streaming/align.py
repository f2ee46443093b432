"""Streaming tick/packet alignment.

Both traces arrive as one stream of ``(site, kind, t)`` rows (kind 0 =
sensor tick, 1 = packet; other kinds only move event time).  Times are read on
a grid of ``resolution_s``: a packet belongs to the first grid point at or
after it, ticks lie on grid points.

State is kept per (site, time bucket): the number of packets at each grid
point, and the tick there, in RocksDB, as a map from blocks of ``BLOCK`` grid
points to the occupied ones.  So its size follows the ticks and occupied grid
points of a bucket, not the packets, and a batch reads and writes each block
that it touches once, however many rows or grid points it has there.  An
event-time timer at the bucket's end emits its packets per own tick plus one
carry row (null tick) with the packets after its last tick; ``assemble_ticks``
adds a carry to the site's next tick.  Rows may arrive in any order within the
watermark delay.  A row of a bucket that is closed already is put out at once
as late (``late`` true), so that every row is either counted or reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowsentry.session import ship_package

OUT_SCHEMA = "site string, bucket long, tick double, n_packets long, late boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: share of a grid cell within which a time counts as on the grid point
SLACK = 1e-6


#: grid points whose counts (or ticks) share one state value
BLOCK = 1024


def _by_cell(cells, values, combine):
    """The distinct cells in order and their values joined by ``combine``."""
    order = np.argsort(cells, kind="stable")
    cells, values = cells[order], values[order]
    if not len(cells):
        return cells, values
    at = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[at], combine.reduceat(values, at)


def _joined(parts, kind):
    """One pair of arrays of (cells, values) pairs."""
    parts = list(parts)
    return (np.concatenate([np.zeros(0, np.int64), *(np.asarray(c, np.int64) for c, _ in parts)]),
            np.concatenate([np.zeros(0, kind), *(np.asarray(v, kind) for _, v in parts)]))


class _Aligner(StatefulProcessor):
    def __init__(self, size_s: float):
        self.size_s = size_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.packets = handle.getMapState("packets", "block long", "cells array<long>, n array<long>")
        self.ticks = handle.getMapState("ticks", "block long", "cells array<long>, tick array<double>")

    def _rows(self, key, ticks, counts, late):
        return pd.DataFrame({"site": str(key[0]), "bucket": int(key[1]), "tick": pd.Series(ticks, dtype="float64"),
                             "n_packets": pd.Series(counts, dtype="int64"), "late": late})

    def _update(self, state, cells, values, add):
        """Puts a batch's cells into their blocks: added to what is there, or in
        its place."""
        for part in np.split(np.arange(len(cells)), np.flatnonzero(np.diff(cells // BLOCK)) + 1) if len(cells) else []:
            block, c, v = (int(cells[part[0]] // BLOCK),), cells[part], values[part]
            old = state.getValue(block)
            if old is not None:
                was, had = _joined([old], v.dtype)
                stays = np.ones(len(was), bool) if add else ~np.isin(was, c)
                c, v = _by_cell(np.concatenate([was[stays], c]), np.concatenate([had[stays], v]), np.add)
            state.updateValue(block, (c.tolist(), v.tolist()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packets, ticks = [], []
        for r in rows:  # chunks of the batch: what is kept of them follows their cells
            kind, cell = r["kind"].to_numpy(), r["cell"].to_numpy(np.int64)
            packets.append(np.unique(cell[kind == 1], return_counts=True))
            ticks.append(_by_cell(cell[kind == 0], r["t"].to_numpy(np.float64)[kind == 0], np.minimum))
        packets, ticks = _by_cell(*_joined(packets, np.int64), np.add), _by_cell(*_joined(ticks, np.float64), np.minimum)
        end = -(-int(key[1] + 1) * int(round(self.size_s * 1e6)) // 1000)
        if end <= timerValues.getCurrentWatermarkInMs():
            # closed: packets counted as late, ticks as late with no packets
            gone = [*[(t, 0) for t in ticks[1]], *([(None, int(packets[1].sum()))] if len(packets[0]) else [])]
            if gone:
                yield self._rows(key, [t for t, _ in gone], [n for _, n in gone], True)
            return
        self._update(self.ticks, *ticks, False)
        self._update(self.packets, *packets, True)
        if len(packets[0]) or len(ticks[0]):
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, ticks = _by_cell(*_joined((v for _, v in self.ticks.iterator()), np.float64), np.minimum)
        cells, n = _by_cell(*_joined((v for _, v in self.packets.iterator()), np.int64), np.add)
        before = np.concatenate([[0], np.cumsum(n)])
        upto = before[np.concatenate([[0], np.searchsorted(cells, at, "right"), [len(cells)]])]
        self.ticks.clear()
        self.packets.clear()
        # a count per tick, and the packets after the last one
        yield self._rows(key, [*ticks, None], np.diff(upto), False)

    def close(self) -> None:
        pass


def stream_align(events: DataFrame, bucket_s: float, watermark_s: float, site: str = "site",
                 resolution_s: float = 0.001) -> DataFrame:
    """``events``: stream of (site, kind, t), t in seconds from an origin at or
    before the first row; output ``OUT_SCHEMA``, final per bucket, to be read
    through ``assemble_ticks`` and ``late_rows``.

    ``resolution_s`` divides ``bucket_s``; ticks off its grid fail the query.
    Rows with a null site, kind or time are left out.
    """
    spark = events.sparkSession
    ship_package(spark)
    if spark.conf.get(PROVIDER) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)
    t = F.col("t").cast("double")
    pos = t / F.lit(float(resolution_s))
    near = F.round(pos)
    cell = F.when(F.col("kind") == 1, F.ceil(pos - SLACK)).when(
        (F.col("kind") == 0) & (F.abs(pos - near) > SLACK),
        F.raise_error(F.concat(F.lit("tick off the grid: "), t.cast("string"))).cast("long")).otherwise(near)
    # event time is left behind, so closed buckets' rows reach the processor
    e = events.where(F.col(site).isNotNull() & F.col("kind").isNotNull() & t.isNotNull()).select(
        F.col(site).cast("string").alias("site"), "kind", t.alias("t"), cell.cast("bigint").alias("cell"),
        F.floor(t / F.lit(float(bucket_s))).cast("bigint").alias("bucket"), F.timestamp_seconds(t).alias("et")) \
        .withWatermark("et", f"{int(round(watermark_s * 1e6))} microseconds").drop("et")
    return e.groupBy("site", "bucket").transformWithStateInPandas(
        _Aligner(bucket_s), OUT_SCHEMA, "append", "EventTime")


def late_rows(parts: DataFrame) -> DataFrame:
    """``(site, bucket, n_packets)`` that came after their bucket was closed."""
    return parts.where("late").groupBy("site", "bucket").agg(F.sum("n_packets").alias("n_packets"))


def assemble_ticks(parts: DataFrame) -> DataFrame:
    """``(site, tick, n_packets)`` of the flushed buckets.  A site's last tick
    is still open (no later tick has flushed it) and is left out, as in the
    batch form."""
    parts = parts.where(~F.col("late"))
    ticks, carry = parts.where("tick is not null"), parts.where("tick is null and n_packets > 0")
    # per site and bucket: its first tick, and the carry of the buckets since
    # the last bucket with ticks (one row per bucket)
    per = ticks.groupBy("site", "bucket").agg(F.min("tick").alias("first"), F.max("tick").alias("top"))
    rows = per.join(carry.groupBy("site", "bucket").agg(F.sum("n_packets").alias("c")), ["site", "bucket"], "full")
    order = Window.partitionBy("site").orderBy("bucket")
    before = F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    given = per.alias("p").join(rows.select("site", "bucket", before.alias("before")), ["site", "bucket"])
    # all carries before a bucket less those before the previous bucket with ticks
    extra = given.withColumn("extra", F.col("before") - F.coalesce(F.lag("before").over(order), F.lit(0))) \
        .select("site", F.col("first").alias("tick"), "extra")
    last = per.groupBy("site").agg(F.max("top").alias("last"))
    return ticks.join(extra, ["site", "tick"], "left").join(last, "site").where("tick < last").select(
        "site", "tick", (F.col("n_packets") + F.coalesce("extra", F.lit(0))).alias("n_packets"))
