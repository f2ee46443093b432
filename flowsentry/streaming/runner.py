"""Run a streaming plan to completion into a parquet sink (tests and the
registered parity queries).  Checkpoints live under the session's shared
checkpoint folder, so a restarted query resumes exactly once."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from flowsentry.session import scratch_path


def run_available_now(spark: SparkSession, df: DataFrame, name: str,
                      out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    out = out or scratch_path(spark, name)
    ck = checkpoint or scratch_path(spark, f"{name}-checkpoint")
    q = (df.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def sliced(spark: SparkSession, df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` stored in a folder per value of ``column``: computed once, and
    ``where(column = i)`` of the result reads the rows of slice ``i`` alone."""
    path = scratch_path(spark, name)
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def state_partitions(spark: SparkSession, most: int):
    """Streams started inside keep their state in at most ``most`` partitions.
    Each costs a task, and a state store's commit, in every micro-batch."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), most)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_foreach_batch(df: DataFrame, fn, checkpoint: str, mode: str = "append"):
    q = (df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def rows_dropped_by_watermark(query) -> int:
    """Late rows the query's stateful operators dropped (from its progress
    reports); the live path reports this instead of silently losing them."""
    total = 0
    for p in query.recentProgress:
        for op in p.stateOperators or []:
            total += int(getattr(op, "numRowsDroppedByWatermark", 0) or 0)
    return total


def run_complete_snapshot(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Run an aggregating stream in complete mode; every micro-batch replaces
    the snapshot folder (idempotent on replay).  Returns the final snapshot."""
    out = scratch_path(spark, name)
    ck = scratch_path(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (df.writeStream.foreachBatch(write).option("checkpointLocation", ck)
         .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
