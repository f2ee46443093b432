"""Flow cleaning, rebasing, validity and quality gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from flowsentry.functions.scalar import clean_numeric, coerce_zero, is_infinite

FLOW_NUMERIC = ("src_pkts", "dst_pkts", "src_bytes", "dst_bytes")
FLOW_REQUIRED = ("ts", "duration", "label")


def clean_flows(df: DataFrame, strict: bool = False) -> DataFrame:
    """Sentinel-clean the byte/packet columns, coerce duration, type ts/label."""
    cols = []
    for name in df.columns:
        if name in FLOW_NUMERIC:
            cols.append(clean_numeric(name, strict).alias(name))
        elif name == "duration":
            cols.append(coerce_zero(name).alias(name))
        elif name == "ts":
            cols.append(F.col(name).cast("double").alias(name))
        elif name == "label":
            cols.append(F.col(name).cast("int").alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def scalar_agg(df: DataFrame, *aggs: Column) -> DataFrame:
    """One-row aggregate, marked for broadcast (its size is one row)."""
    return F.broadcast(df.agg(*aggs))


def rebase(df: DataFrame, col: str = "ts") -> DataFrame:
    """Shift ``col`` so its minimum over *all* rows becomes 0.

    The minimum is a partial+final aggregate joined as a one-row broadcast,
    never ``min() OVER ()`` (that funnels every row through one task).
    """
    t0 = scalar_agg(df, F.min(col).alias("_t0"))
    return (df.crossJoin(t0)
            .withColumn(col, F.col(col) - F.col("_t0"))
            .drop("_t0"))


def valid_flows(df: DataFrame) -> DataFrame:
    return df.where(F.col("duration") > 0)


def dropna(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def by_label(df: DataFrame, value: int, col: str = "label") -> DataFrame:
    return df.where(F.col(col) == value)


def nonzero(df: DataFrame, cols: Sequence[str] = ("flow_count", "avg_duration", "avg_bytes")) -> DataFrame:
    """Drop rows whose feature values are all zero (they are not scored)."""
    all_zero = None
    for c in cols:
        t = F.col(c) == 0
        all_zero = t if all_zero is None else all_zero & t
    return df.where(~all_zero)


def parse_or_reject(df: DataFrame, parsed: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Add parsed columns; rows where any parse gives NULL go to rejects.

    Returns ``(good, rejects)``; ``rejects`` carries ``reject_reason``
    naming the first failing column.
    """
    d = df
    for name, expr in parsed.items():
        d = d.withColumn(name, expr)
    bad = None
    reason = F.lit(None).cast("string")
    for name in reversed(list(parsed)):
        isnull = F.col(name).isNull()
        reason = F.when(isnull, F.lit(name)).otherwise(reason)
        bad = isnull if bad is None else bad | isnull
    good = d.where(~bad)
    rejects = d.where(bad).withColumn("reject_reason", reason)
    return good, rejects


def flow_counts(df: DataFrame) -> DataFrame:
    """Loaded vs valid flow counts (one row)."""
    return df.agg(F.count(F.lit(1)).alias("n_flows"),
                  F.count_if(F.col("duration") > 0).alias("n_valid"))


def quality_gate(df: DataFrame, required: Sequence[str] = FLOW_REQUIRED,
                 raw: DataFrame | None = None) -> DataFrame:
    """One-row gate report: missing columns, rows, valid rows, attack rows, and
    (with the ``raw`` flows) values that overflow to an infinity.

    ``ok``: there are valid flows; ``attack_ok``: some of them are attacks
    (profiles by class need both).
    """
    schema = ("missing_columns string, n_rows long, n_valid long, n_attack long, n_infinite long, ok boolean, "
              "attack_ok boolean")
    missing = [c for c in required if c not in df.columns]
    if missing:
        return df.sparkSession.createDataFrame([(",".join(missing), 0, 0, 0, 0, False, False)], schema)
    g = df.agg(F.count(F.lit(1)).alias("n_rows"),
               F.count_if(F.col("duration") > 0).alias("n_valid"),
               F.count_if((F.col("duration") > 0) & (F.col("label") == 1)).alias("n_attack"))
    if raw is None:
        g = g.withColumn("n_infinite", F.lit(0).cast("bigint"))
    else:
        cols = [c for c in (*FLOW_NUMERIC, "duration") if c in raw.columns]
        n = F.lit(0).cast("bigint")
        for c in cols:
            n = n + F.count_if(is_infinite(c))
        g = g.crossJoin(F.broadcast(raw.agg(n.alias("n_infinite"))))
    return g.select(F.lit("").alias("missing_columns"), "n_rows", "n_valid", "n_attack", "n_infinite",
                    (F.col("n_valid") > 0).alias("ok"), (F.col("n_attack") > 0).alias("attack_ok"))


GATE = "flow_gate"


def gated_flows(raw: DataFrame, strict: bool = False, watch: Observation | str = GATE,
                required: Sequence[str] = FLOW_REQUIRED) -> DataFrame:
    """Cleaned flows that count themselves as they are scanned: ``observe``
    sums (``n_rows, n_valid, n_attack, n_infinite``) over the rows that pass, so
    the gate needs no scan of its own.  In a batch ``watch`` is an
    ``Observation``, to be read after the action; on a stream it is a name, and
    every progress report has the sums of its micro-batch under it.  A missing
    column raises at once.

    Read a batch that is watched through a session of its own
    (``spark.newSession()``): a session that holds an observation cannot send a
    fitted MLlib forest to its tasks any more."""
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"missing required columns: {','.join(missing)}")
    odd = F.lit(0)
    for c in (*FLOW_NUMERIC, "duration"):
        if c in raw.columns:
            odd = odd + is_infinite(c).cast("int")
    d = clean_flows(raw.withColumn("_infinite", odd), strict)
    valid = F.col("duration") > 0
    return d.observe(watch, F.count(F.lit(1)).alias("n_rows"), F.count_if(valid).alias("n_valid"),
                     F.count_if(valid & (F.col("label") == 1)).alias("n_attack"),
                     F.coalesce(F.sum("_infinite"), F.lit(0)).alias("n_infinite")).drop("_infinite")


def gate_row(spark, sums: dict) -> DataFrame:
    """The report of ``quality_gate`` from observed sums (no rows: zeros)."""
    n = {c: int(sums.get(c) or 0) for c in ("n_rows", "n_valid", "n_attack", "n_infinite")}
    return spark.createDataFrame(
        [("", *n.values(), n["n_valid"] > 0, n["n_attack"] > 0)],
        "missing_columns string, n_rows long, n_valid long, n_attack long, n_infinite long, ok boolean, attack_ok boolean")


def validate_flows(df: DataFrame, required: Sequence[str] = FLOW_REQUIRED) -> dict:
    """Raise on a missing column or an empty valid set; return the gate row.

    Only a one-row aggregate reaches the driver.
    """
    row = quality_gate(df, required).first().asDict()
    if row["missing_columns"]:
        raise ValueError(f"missing required columns: {row['missing_columns']}")
    if not row["ok"]:
        raise ValueError("no valid flows (duration > 0) after filtering")
    return row
