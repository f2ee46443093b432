"""Deterministic stratified split, k-fold ids, warm-up subsets, overlap
(W1, W2, W3, P10, J4).

Row order inside a class is ``md5("<seed>:<key>")`` then the key: the same
hex digest in any engine, so a split is reproducible and checkable.  Ranks
are computed with the two-level running count (bucket = first three hex
digits of the digest, 4096 buckets per class), so the majority class is
spread over thousands of tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.operators.prefix import running_aggregate

HASH_PREFIX_DIGITS = 3


def order_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def class_rank(df: DataFrame, label: str = "label", key: str = "window",
               seed: int = 42, out: str = "rank") -> DataFrame:
    """1-based rank of each row inside its class, in digest order."""
    d = df.withColumn("_h", order_hash(key, seed)).withColumn("_one", F.lit(1))
    bucket = F.conv(F.substring("_h", 1, HASH_PREFIX_DIGITS), 16, 10).cast("int")
    r = running_aggregate(d, keys=[label], order=["_h", key], value="_one", out=out,
                          bucket=bucket)
    return r.withColumn(out, F.col(out).cast("bigint")).drop("_one", "_h")


def class_quotas(df: DataFrame, label: str = "label", test_frac: float = 0.3) -> DataFrame:
    """Per-class train/test sizes: n_test = ceil(frac * n), train sizes by
    largest remainder (ties to the smaller class value).

    Works on the per-class count table (one row per class), so the
    un-partitioned windows below see only a handful of rows.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    allw = Window.partitionBy()
    n = F.sum("n_class").over(allw)
    c = counts.withColumn("_n", n)
    c = c.withColumn("_n_train", F.col("_n") - F.ceil(F.lit(float(test_frac)) * F.col("_n")))
    c = c.withColumn("_cont", F.col("_n_train") * F.col("n_class") / F.col("_n"))
    c = c.withColumn("_floor", F.floor("_cont"))
    c = c.withColumn("_need", F.col("_n_train") - F.sum("_floor").over(allw))
    c = c.withColumn("_r", F.row_number().over(
        Window.orderBy(F.desc(F.col("_cont") - F.col("_floor")), F.col(label))))
    c = c.withColumn("train_quota",
                     (F.col("_floor") + (F.col("_r") <= F.col("_need")).cast("int")).cast("bigint"))
    return c.select(label, F.col("n_class").cast("bigint").alias("n_class"), "train_quota",
                    (F.col("n_class") - F.col("train_quota")).cast("bigint").alias("test_quota"))


def stratified_split(df: DataFrame, label: str = "label", key: str = "window",
                     test_frac: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds ``rank`` (in-class digest order) and ``split`` ('train'/'test').

    Sizes are exact: train holds the first ``train_quota`` rows of each class.
    """
    ranked = class_rank(df, label, key, seed)
    # One row per class value: bounded by the label domain.
    q = F.broadcast(class_quotas(df, label, test_frac).select(label, "train_quota"))
    out = ranked.join(q, label, "left")
    return out.withColumn(
        "split", F.when(F.col("rank") <= F.col("train_quota"), "train").otherwise("test")
    ).drop("train_quota")


def kfold(df: DataFrame, label: str = "label", key: str = "window", k: int = 5,
          seed: int = 42) -> DataFrame:
    """Stratified fold ids: rows of each class dealt round-robin in digest order."""
    r = class_rank(df, label, key, seed)
    return r.withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int"))


def warmup_fraction(split_df: DataFrame, frac: float = 0.1, label: str = "label",
                    benign: int = 0) -> DataFrame:
    """First ``max(1, int(frac * n))`` benign training rows in digest order.

    Training rows of a class are exactly ranks 1..train_quota, so the warm-up
    is a rank cut-off; the count comes from a one-row aggregate.
    """
    train_benign = split_df.where((F.col("split") == "train") & (F.col(label) == benign))
    quota = F.broadcast(train_benign.agg(
        F.greatest(F.lit(1), F.floor(F.lit(float(frac)) * F.count(F.lit(1)))).alias("_wq")))
    return (train_benign.crossJoin(quota)
            .where(F.col("rank") <= F.col("_wq")).drop("_wq"))


def warmup_time(df: DataFrame, n_windows: int = 6, label: str = "label",
                col: str = "window") -> tuple[DataFrame, DataFrame]:
    """Time-ordered warm-up: (benign windows before ``n_windows``, the rest)."""
    warm = (F.col(col) < n_windows) & (F.col(label) == 0)
    return df.where(warm), df.where(~warm)


def overlap(a: DataFrame, b: DataFrame, key: str = "window") -> DataFrame:
    """Leakage check: number of distinct keys present in both sets (one row)."""
    both = a.select(key).intersect(b.select(key))
    return both.agg(F.count(F.lit(1)).alias("n_overlap"))
