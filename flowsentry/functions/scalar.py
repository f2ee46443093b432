"""Scalar column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal / exponent number with optional sign and surrounding
# blanks.  Java-only spellings ("1.0d", "2f", "NaN", "Infinity") do not
# match, so they coerce to 0 like any other garbage.
NUMERIC_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parsed(c) -> Column:
    s = _col(c).cast("string")
    return F.when(s.rlike(NUMERIC_PATTERN), s.try_cast("double"))


def numeric(c) -> Column:
    """A finite plain number, else NULL."""
    p = _parsed(c)
    return F.when(F.abs(p) != F.lit(float("inf")), p)


def is_infinite(c) -> Column:
    """A plain number that overflows to an infinity (counted by the gates)."""
    return F.coalesce(F.abs(_parsed(c)) == F.lit(float("inf")), F.lit(False))


def coerce_zero(c) -> Column:
    """Parse a number; anything unparseable, missing or overflowing to an
    infinity becomes 0.0."""
    return F.coalesce(numeric(c), F.lit(0.0))


def clean_numeric(c, strict: bool = False) -> Column:
    """Sentinel clean: every '-' character is replaced by '0' before parsing.

    The replacement is textual (so '-5' becomes 5 and '1-2' becomes 102);
    ``strict=True`` only maps a value that is exactly '-' to 0.
    """
    s = _col(c).cast("string")
    if strict:
        return F.when(F.trim(s) == "-", F.lit(0.0)).otherwise(coerce_zero(s))
    return coerce_zero(F.replace(s, F.lit("-"), F.lit("0")))


def window_id(ts, size: float) -> Column:
    """Tumbling window number of a non-negative time in seconds."""
    return F.floor(_col(ts) / F.lit(float(size))).cast("bigint")


def map_values(c, mapping: Mapping, default=None) -> Column:
    """Value mapping; unmapped values keep their text (or ``default``)."""
    expr = None
    src = _col(c)
    for k, v in mapping.items():
        cond = src == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    fallback = src.cast("string") if default is None else F.lit(default)
    return expr.otherwise(fallback) if expr is not None else fallback


def band(c, steps: Sequence[tuple[float | None, str]]) -> Column:
    """Absolute threshold bands: the last step whose floor is <= value wins.

    ``steps`` is ordered ascending; the first step has floor ``None`` (base).
    A NULL value stays NULL.
    """
    v = _col(c)
    expr = F.lit(steps[0][1])
    for floor_, name in steps[1:]:
        expr = F.when(v >= F.lit(floor_), F.lit(name)).otherwise(expr)
    return F.when(v.isNotNull(), expr)


def percent(a, b) -> Column:
    """100 * a / b, NULL when b is 0 or NULL."""
    return F.lit(100.0) * _col(a) / F.nullif(_col(b), F.lit(0.0))


# Fixed values (must equal the reference's detector status text):
VERDICT_ATTACK = "THREAT DETECTED"
VERDICT_NORMAL = "NORMAL"


def verdict(pred) -> Column:
    return F.when(_col(pred) == 1, F.lit(VERDICT_ATTACK)).otherwise(F.lit(VERDICT_NORMAL))


def iso_label(decision) -> Column:
    """Anomaly remap: a negative decision value is an anomaly (1)."""
    return (_col(decision) < 0).cast("int")


def error_match(text) -> Column:
    """Case-insensitive 'error' or 'failed' anywhere in the line."""
    return _col(text).rlike("(?i)(error|failed)")


def epoch_seconds(df, col: str) -> Column:
    """Seconds since 1970-01-01 as DOUBLE, independent of the session time
    zone: a TIMESTAMP_NTZ or DATE is read as a UTC wall clock, a TIMESTAMP
    (an instant) converts directly."""
    from pyspark.sql import types as T
    dt = df.schema[col].dataType
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(F.col(col)) / F.lit(1e6)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    c = F.col(col).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, c) / F.lit(1e6)
