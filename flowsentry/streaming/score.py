"""Continuous scoring and metric publication."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.operators.cleaning import nonzero
from flowsentry.operators.metrics import to_metric_samples
from flowsentry.streaming.committed import CommittedTable, committed_sink

# The detector's published gauges
SCORE_GAUGES = {"pred": "ai_anomaly_score", "attack_probability": "ai_attack_probability"}
LATENCY_GAUGE = "ai_inference_latency_ms"


def stream_score(windows: DataFrame, model: PipelineModel, skip_zero: bool = True) -> DataFrame:
    """Score every (non-all-zero) window of a stream with a fitted pipeline."""
    w = nonzero(windows) if skip_zero else windows
    out = model.transform(w.withColumn("label", F.col("label").cast("double")))
    return out.select("window", F.col("label").cast("int").alias("label"),
                      F.col("flow_count"), F.col("avg_duration"), F.col("avg_bytes"),
                      F.col("prediction").cast("int").alias("pred"),
                      vector_to_array("probability")[1].alias("attack_probability"))


def publisher(path: str, size_s: float):
    """foreachBatch function: append gauge samples of a scored micro-batch
    (prediction and probability, stamped at the window start) to a metric
    table.  Each scored row is read once and unpivoted.  Writes are keyed by
    batch id, so a replayed batch overwrites its own folder; an empty batch
    writes nothing."""
    def publish(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("ts", F.col("window") * F.lit(float(size_s)))
        out = to_metric_samples(rows, "ts", SCORE_GAUGES).persist()
        try:
            if not out.isEmpty():
                out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            out.unpersist()
    return publish


def committed_publisher(table: CommittedTable, size_s: float, writer: str = "detector"):
    """``publisher`` into a table with a commit log: replayed batches are
    skipped, and the number of files stays bounded however long it runs."""
    return committed_sink(table, writer, lambda batch: to_metric_samples(
        batch.withColumn("ts", F.col("window") * F.lit(float(size_s))), "ts", SCORE_GAUGES))


def latency_samples(query) -> DataFrame:
    """Inference-latency gauge of a query's micro-batches: when the trigger
    started (epoch seconds) and how long it spent on its rows, from the progress
    reports that Spark still holds (the last hundred; ``progress.ProgressRecorder``
    has them all).  Batches without input rows have no sample."""
    from datetime import datetime
    rows = [(LATENCY_GAUGE, datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp(),
             float(p.durationMs.get("addBatch", 0)))
            for p in query.recentProgress if p.numInputRows]
    return SparkSession.getActiveSession().createDataFrame(rows, "metric string, ts double, value double")
