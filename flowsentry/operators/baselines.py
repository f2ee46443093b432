"""Statistical threshold detector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigma_threshold(train: DataFrame, k: float = 2.0, col: str = "flow_count",
                    label: str = "label") -> DataFrame:
    """mean + k * sample std of ``col`` over benign training rows (one row)."""
    b = train.where(F.col(label) == 0)
    g = b.agg(F.avg(F.col(col).cast("double")).alias("mean"),
              F.stddev_samp(F.col(col).cast("double")).alias("std"))
    return g.withColumn("threshold", F.col("mean") + F.lit(float(k)) * F.col("std"))


def threshold_predictions(test: DataFrame, threshold: DataFrame, col: str = "flow_count",
                          key: str = "window", label: str = "label",
                          model: str = "threshold") -> DataFrame:
    """Scored rows: pred = value > threshold (strict), score = value.

    The threshold is a one-row frame joined as a broadcast.
    """
    thr = F.broadcast(threshold.select("threshold"))
    return test.crossJoin(thr).select(
        F.lit(model).alias("model"), F.col(key).cast("bigint").alias("id"),
        F.col(label).cast("int").alias("label"),
        F.col(col).cast("double").alias("score"),
        (F.col(col) > F.col("threshold")).cast("int").alias("pred"),
    )


def sigma_detector(train: DataFrame, test: DataFrame, k: float = 2.0,
                   col: str = "flow_count", key: str = "window") -> DataFrame:
    return threshold_predictions(test, sigma_threshold(train, k, col), col, key)
