"""Metric samples as a stream of scrape ticks.

A streaming data source over parquet files of metric samples.  Its offset is a
tick: tick n holds the samples of ``[n * step, (n + 1) * step)`` seconds.  A
trigger takes at most ``max_ticks`` ticks (admission control), read by one task
per file that has samples among them, with the tick range pushed to the file.

Spark asks the source for an end before it knows where a restarted query
stands, so the source notes the last tick it handed out under ``progress``
before it answers.  Every answer is at or after any offset in a checkpoint, and
batches follow each other without gap or overlap.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "scrape"
SCHEMA = "metric string, device int, ts double, seq long, value double"
# Fixed value: the scrape interval
STEP = 5.0


def _filesystem(path: str):
    from pyarrow import fs
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class TickRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ScrapeReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.progress = options["path"], options["progress"]
        self.step = float(options.get("step", STEP))
        self.most = int(options.get("max_ticks", 12))
        #: with ``closed`` no more samples come, so the last tick is whole
        self.closed = str(options.get("closed", "false")).lower() == "true"
        self.spans: dict[str, tuple[float, float]] = {}
        self.handed = self._noted()

    # -- files -------------------------------------------------------------
    def _look(self) -> None:
        """Lists the files; the time range of a new one is read off its footer."""
        import pyarrow.parquet as pq
        from pyarrow import fs
        store, root = _filesystem(self.path)
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if not info.path.endswith(".parquet") or info.path in self.spans:
                continue
            with store.open_input_file(info.path) as f:
                meta = pq.ParquetFile(f).metadata
            col = [meta.schema.column(i).name for i in range(meta.num_columns)].index("ts")
            stats = [meta.row_group(i).column(col).statistics for i in range(meta.num_row_groups)]
            if stats:
                self.spans[info.path] = (min(s.min for s in stats), max(s.max for s in stats))

    def _tick(self, ts: float) -> int:
        return int(ts // self.step)

    # -- offsets -----------------------------------------------------------
    def _noted(self) -> int | None:
        store, path = _filesystem(f"{self.progress}/handed.json")
        try:
            with store.open_input_file(path) as f:
                return int(json.loads(f.read())["tick"])
        except FileNotFoundError:
            return None

    def _note(self, tick: int) -> None:
        store, path = _filesystem(f"{self.progress}/handed.json")
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path + ".new") as f:
            f.write(json.dumps({"tick": tick}).encode())
        store.move(path + ".new", path)

    def initialOffset(self) -> dict:
        self._look()
        return {"tick": self._tick(min(lo for lo, _ in self.spans.values())) if self.spans else 0}

    def latestOffset(self) -> dict:
        self._look()
        if not self.spans:
            return {"tick": self.handed or 0}
        first = self._tick(min(lo for lo, _ in self.spans.values()))
        last = self._tick(max(hi for _, hi in self.spans.values())) + (1 if self.closed else 0)
        at = first if self.handed is None else self.handed
        end = max(at, min(at + self.most, last))
        if end != self.handed:
            self._note(end)
            self.handed = end
        return {"tick": end}

    def partitions(self, start: dict, end: dict) -> list[TickRange]:
        a, b = start["tick"], end["tick"]
        self._look()
        return [TickRange(p, a, b) for p, (lo, hi) in sorted(self.spans.items())
                if self._tick(lo) < b and self._tick(hi) >= a and a < b]

    def read(self, partition: TickRange) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        kinds = pa.schema([("metric", pa.string()), ("device", pa.int32()), ("ts", pa.float64()), ("seq", pa.int64()),
                           ("value", pa.float64())])
        low, high = partition.start * self.step, partition.end * self.step
        store, _ = _filesystem(self.path)
        with store.open_input_file(partition.path) as f:
            parquet = pq.ParquetFile(f)
            col = parquet.schema_arrow.get_field_index("ts")
            for g in range(parquet.num_row_groups):
                s = parquet.metadata.row_group(g).column(col).statistics
                if s is not None and (s.max < low or s.min >= high):
                    continue
                for batch in parquet.iter_batches(row_groups=[g], columns=kinds.names):
                    ts = batch.column(batch.schema.get_field_index("ts"))
                    mine = batch.filter(pc.and_(pc.greater_equal(ts, low), pc.less(ts, high)))
                    if mine.num_rows:
                        yield from pa.Table.from_batches([mine]).select(kinds.names).cast(kinds).to_batches()


class ScrapeSource(DataSource):
    """``spark.readStream.format("scrape")`` with options ``path`` (folder of
    parquet files), ``progress`` (folder of the query's own, beside its
    checkpoint), ``step`` (seconds), ``max_ticks`` and ``closed``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ScrapeReader:
        return ScrapeReader(dict(self.options))


def scrape_stream(spark, path: str, progress: str, step: float = STEP, max_ticks: int = 12, closed: bool = False):
    """The stream of samples, tick by tick."""
    spark.dataSource.register(ScrapeSource)
    return spark.readStream.format(NAME).option("path", path).option("progress", progress).option("step", str(step)) \
        .option("max_ticks", str(max_ticks)).option("closed", str(closed).lower()).load()
