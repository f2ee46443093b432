"""Progress metrics of streaming queries, pushed as they happen.

Spark keeps the last hundred progress reports of a query; a listener gets every
one.  ``ProgressRecorder`` turns each into metric samples and appends them to a
``CommittedTable``, so the late rows and latencies of a query that runs for
weeks are all there, and stay after it ends.
"""

from __future__ import annotations

import threading
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from flowsentry.streaming.committed import CommittedTable

LATENCY, LATE, ROWS = "ai_inference_latency_ms", "stream_late_rows", "stream_input_rows"
PROGRESS_SCHEMA = "query string, batch long, metric string, ts double, value double"


def progress_samples(p) -> list[tuple]:
    """Metric samples of one progress report.  Late rows are those that the
    stateful operators dropped behind the watermark; an aggregation counts them
    after combining the rows of a batch, so once per group and batch.  Latency
    is only given for a batch with input.  Sums that the query observes are
    samples as well, named ``<observation>.<sum>``."""
    ts = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp()
    late = sum(int(s.numRowsDroppedByWatermark or 0) for s in p.stateOperators or [])
    out = [(LATE, float(late)), (ROWS, float(p.numInputRows))]
    if p.numInputRows:
        out.append((LATENCY, float(p.durationMs.get("addBatch", 0))))
    for name, sums in (p.observedMetrics or {}).items():
        out += [(f"{name}.{k}", float(v)) for k, v in sums.asDict().items() if v is not None]
    return [(str(p.id), int(p.batchId), metric, ts, value) for metric, value in out]


class ProgressRecorder(StreamingQueryListener):
    """Records the queries whose ids ``watch`` was called with (all, if none).

    Samples gather in the driver for at most ``every`` reports (a few hundred
    bytes each) and are then appended; ``flush`` appends what is left, as does
    the end of a query.  A report that Spark sends twice counts once."""

    def __init__(self, table: CommittedTable, every: int = 25):
        self.table, self.every = table, every
        self.watched: set[str] = set()
        self._rows: dict[tuple, tuple] = {}
        self._reports = 0
        self._lock = threading.RLock()
        self._batch = table.state()[2].get("progress", -1) + 1

    def watch(self, query) -> None:
        self.watched.add(str(query.id))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.watched and str(p.id) not in self.watched:
            return
        with self._lock:
            for row in progress_samples(p):
                self._rows[row[:3]] = row
            self._reports += 1
            full = self._reports >= self.every
        if full:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()

    def flush(self) -> None:
        with self._lock:
            rows, self._rows, self._reports = list(self._rows.values()), {}, 0
            if rows:
                self.table.append(self.table.spark.createDataFrame(rows, PROGRESS_SCHEMA).coalesce(1), "progress", self._batch)
                self._batch += 1


def recorded(spark: SparkSession, table_path: str, start, every: int = 25) -> DataFrame:
    """Runs the query that ``start()`` starts to its end with a recorder and
    returns all its samples, the reports of one batch number once."""
    recorder = ProgressRecorder(CommittedTable(spark, table_path, PROGRESS_SCHEMA), every)
    spark.streams.addListener(recorder)
    try:
        query = start()
        query.awaitTermination()
        last = query.lastProgress
        _wait_for(recorder, query, last)
    finally:
        spark.streams.removeListener(recorder)
    recorder.flush()
    return recorder.table.read().where(F.col("query") == str(query.id)).dropDuplicates(["query", "batch", "metric"])


def _wait_for(recorder: ProgressRecorder, query, last, seconds: float = 60.0) -> None:
    """The listener bus is asynchronous: waits until the last report is in."""
    import time
    if last is None:
        return
    end = time.time() + seconds
    while time.time() < end:
        with recorder._lock:
            if any(r[0] == str(query.id) and r[1] >= last.batchId for r in recorder._rows.values()):
                return
        found = recorder.table.read().where((F.col("query") == str(query.id)) & (F.col("batch") >= last.batchId))
        if not found.isEmpty():
            return
        time.sleep(0.3)
    raise RuntimeError("the last progress report did not arrive")
