"""Log analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.scalar import error_match
from flowsentry.operators.prefix import top_k_per_group


def error_lines(logs: DataFrame, text: str = "text") -> DataFrame:
    """Lines containing 'error' or 'failed', any case."""
    return logs.where(error_match(text))


def error_counts(logs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    return error_lines(logs, text).groupBy(source).agg(F.count(F.lit(1)).alias("n_errors"))


def error_head(logs: DataFrame, n: int = 20, source: str = "source", line: str = "line",
               text: str = "text") -> DataFrame:
    """First ``n`` matching lines of every source (line order)."""
    return top_k_per_group(error_lines(logs, text), [source], [line], n)
