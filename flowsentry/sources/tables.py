"""Access to the base parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsentry.session import table_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
