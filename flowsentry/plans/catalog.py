"""Query registry.

``@query(name, sql=..., doubles=[...])`` registers a Spark plan
``fn(spark, sf_dir) -> DataFrame`` and, when the semantics are
SQL-expressible, the DuckDB text of the same result.  Double columns are
rounded to 6 decimals on both sides so the value hashes are stable.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from flowsentry.session import ship_package

ROUND_DIGITS = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def round_doubles(df: DataFrame, digits: int = ROUND_DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def duck_round(sql: str, doubles: Sequence[str], digits: int = ROUND_DIGITS) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f'round(cast("{c}" as double), {digits}) AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS q"


def query(name: str, sql: str | None = None, doubles: Sequence[str] = ()):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = duck_round(sql, doubles)
        return fn
    return deco


def load_all() -> None:
    """Import every query module (registration is an import side effect)."""
    from flowsentry.plans import (  # noqa: F401
        q_core, q_detect, q_detector, q_io, q_metrics, q_models, q_stats, q_stream, q_trace,
    )
