"""Streaming time-to-alert (T3) and the write-once alert sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.operators.alerts import time_to_alert
from flowsentry.streaming.committed import CommittedTable

ALERT_SCHEMA = ("device string, first_attack_label_ts double, first_detection_ts double, "
                "time_to_alert_seconds double")


def stream_time_to_alert(scored: DataFrame, device: str = "device") -> DataFrame:
    """First label, first detection and their distance per device: the batch
    aggregate, kept up to date by the stream (update mode).  State is two
    doubles per device, and a device with most rows is combined map-side."""
    return time_to_alert(scored.withColumn(device, F.col(device).cast("string")), by=[device])


def alert_sink(path: str):
    """foreachBatch sink: a device's alert is written once, by the first batch
    in which both times are known; batches without a new alert write nothing.
    A replayed batch replaces its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        ready = batch.where("time_to_alert_seconds is not null").select(*[c.split()[0] for c in ALERT_SCHEMA.split(", ")])
        known = read_alerts(batch.sparkSession, path, below=batch_id).select("device")
        new = ready.join(known, "device", "left_anti")
        if not new.isEmpty():
            new.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")
    return write


def committed_alerts(table: CommittedTable, writer: str = "alerts"):
    """``alert_sink`` into a table with a commit log (schema ``ALERT_SCHEMA``):
    a device's alert is written once, whichever batches are replayed."""
    def write(batch: DataFrame, batch_id: int) -> None:
        ready = batch.where("time_to_alert_seconds is not null").select(*[c.split()[0] for c in ALERT_SCHEMA.split(", ")])
        table.append(ready.join(table.read().select("device"), "device", "left_anti").select(*ready.columns), writer, batch_id)
    return write


def read_alerts(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """Alerts written so far (an absent folder has none)."""
    from pyspark.errors import AnalysisException
    try:
        df = spark.read.schema(ALERT_SCHEMA + ", batch_id long").option("basePath", path).json(f"{path}/batch_id=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ALERT_SCHEMA)
    if below is not None:
        df = df.where(F.col("batch_id") < below)
    return df.drop("batch_id")
