"""Detector evaluation over a scored set ``(model, id, label, score, pred)``
(A5-A9, A20, J5, O3, M10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.operators.prefix import range_running, sorted_rank

SWEEP_THRESHOLDS = (0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90)
REPORT_METRICS = ("precision", "recall", "f1_score", "roc_auc", "fpr", "fnr")


def _ratio(num, den):
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def confusion(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """TP/FP/FN/TN per model in one grouped pass."""
    pos, pp = F.col("label") == 1, F.col("pred") == 1
    return scored.groupBy(*by).agg(
        F.count_if(pos & pp).alias("tp"), F.count_if(~pos & pp).alias("fp"),
        F.count_if(pos & ~pp).alias("fn"), F.count_if(~pos & ~pp).alias("tn"))


def with_rates(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1, FPR, FNR with zero-division -> 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return conf.select(
        "*",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        _ratio(fp, fp + tn).alias("fpr"),
        _ratio(fn, fn + tp).alias("fnr"),
    )


def detection_metrics(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return with_rates(confusion(scored, by))


def _score_counts(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per (model, distinct score) with positive / negative counts: value
    skew collapses here.  Checkpointed (into the shared checkpoint folder)
    because several branches read it."""
    return scored.groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") != 1).alias("neg")).checkpoint(eager=True)


def roc_auc(scored: DataFrame, by: Sequence[str] = ("model",), buckets: int | None = None) -> DataFrame:
    """Tie-aware ROC-AUC (Mann-Whitney): sum over positives of
    (negatives below + half the tied negatives) / (P * N).  NULL with one class.

    Scores are grouped first; negatives-below is a running sum over score
    ranges, whose number (``buckets``) follows the distinct scores.
    """
    by = list(by)
    c = range_running(_score_counts(scored, by), by, ["score"], "neg", "neg_below", ranges=buckets, inclusive=False)
    term = F.col("pos") * (F.coalesce(F.col("neg_below"), F.lit(0)) + F.lit(0.5) * F.col("neg"))
    agg = c.groupBy(*by).agg(F.sum(term).alias("_u"),
                             F.sum("pos").cast("double").alias("_p"),
                             F.sum("neg").cast("double").alias("_n"))
    return agg.select(*by, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                  F.col("_u") / (F.col("_p") * F.col("_n"))).alias("roc_auc"))


def roc_curve(scored: DataFrame, by: Sequence[str] = ("model",), buckets: int | None = None) -> DataFrame:
    """ROC points, one per distinct score (descending) plus the origin, whose
    threshold is NULL (above every score).  Collinear points are kept."""
    by = list(by)
    g = _score_counts(scored, by)
    c = range_running(g, by, [F.col("score").desc()], ["pos", "neg"], ["cum_pos", "cum_neg"], ranges=buckets)
    # one row per model
    totals = F.broadcast(g.groupBy(*by).agg(F.sum("pos").cast("double").alias("_P"),
                                            F.sum("neg").cast("double").alias("_N")))
    pts = c.select(*by, F.col("score").alias("threshold"), "cum_pos", "cum_neg")
    origin = totals.select(*by, F.lit(None).cast("double").alias("threshold"),
                           F.lit(0).cast("bigint").alias("cum_pos"),
                           F.lit(0).cast("bigint").alias("cum_neg"))
    allp = pts.unionByName(origin).join(totals, by)
    return allp.select(
        *by, "threshold",
        F.when(F.col("_N") > 0, F.col("cum_neg") / F.col("_N")).alias("fpr"),
        F.when(F.col("_P") > 0, F.col("cum_pos") / F.col("_P")).alias("tpr"))


def _rates_long(wide: DataFrame, by: Sequence[str], levels: Sequence[float], level_col: str,
                extra: Sequence[str] = ()) -> DataFrame:
    """Unstack per-level ``tp_i / fp_i / fn_i / tn_i`` columns into one row
    per (key, level) and add the rates."""
    parts = []
    for i, t in enumerate(levels):
        parts.append(F.struct(F.lit(float(t)).alias(level_col),
                              *[F.col(f"{e}_{i}").alias(e) for e in extra],
                              *[F.col(f"{c}_{i}").alias(c) for c in ("tp", "fp", "fn", "tn")]))
    long = wide.select(*by, F.explode(F.array(*parts)).alias("_s")).select(*by, "_s.*")
    return with_rates(long)


def sweep_counts(scored: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ("model",),
                 strict: bool = False) -> DataFrame:
    """Confusion counts at any number of thresholds in one grouped pass.
    ``pred = score >= t`` (``score > t`` with ``strict``).

    Every row finds by binary search how many of the sorted thresholds it
    reaches; one histogram of that number per model, and sums from its top down
    give the counts at each threshold.  A null score counts nowhere.
    """
    by, spark = list(by), scored.sparkSession
    levels = sorted(float(t) for t in thresholds)
    line = F.broadcast(spark.range(1).select(F.array(*[F.lit(t) for t in levels]).alias("_levels")))
    x = scored.where(F.col("score").isNotNull()).select(*by, "label", F.col("score").cast("double").alias("_x"))
    x = sorted_rank(x.crossJoin(line), "_levels", "_x", "_at", len(levels), inclusive=not strict)
    hist = x.groupBy(*by, "_at").agg(F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") != 1).alias("_n"))
    # one row per model and threshold (level 0: below all), none or more rows behind it
    zero = F.lit(0).cast("bigint")
    grid = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("_p")).select(
        *by, F.explode(F.sequence(F.lit(0), F.lit(len(levels)))).alias("_at"), zero.alias("_p"), zero.alias("_n"))
    grid = grid.unionByName(hist).groupBy(*by, "_at").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    top = Window.partitionBy(*by).orderBy(F.col("_at").desc())
    whole = Window.partitionBy(*by)
    cum = grid.select(*by, "_at", F.sum("_p").over(top).alias("tp"), F.sum("_n").over(top).alias("fp"),
                      F.sum("_p").over(whole).alias("_P"), F.sum("_n").over(whole).alias("_N")).where("_at > 0")
    named = cum.crossJoin(line).withColumn("threshold", F.element_at("_levels", F.col("_at")))
    return with_rates(named.select(*by, "threshold", "tp", "fp", (F.col("_P") - F.col("tp")).alias("fn"),
                                   (F.col("_N") - F.col("fp")).alias("tn")))


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS,
                    by: Sequence[str] = ("model",)) -> DataFrame:
    """Precision/recall/F1 at each probability threshold (score >= t) in one
    grouped pass, with the (threshold-independent) ROC-AUC."""
    by = list(by)
    rates = sweep_counts(scored, thresholds, by)
    auc = roc_auc(scored, by)
    return rates.join(auc, by, "left").select(
        *by, "threshold", "precision", "recall", "f1_score", "roc_auc")


def evaluation_report(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Per-model report: counts, rates and ROC-AUC."""
    by = list(by)
    return detection_metrics(scored, by).join(roc_auc(scored, by), by, "left").select(
        *by, "precision", "recall", "f1_score", "roc_auc", "fpr", "fnr", "tp", "tn", "fp", "fn")


def confusion_pct(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Confusion cells as percent of the model's total."""
    by = list(by)
    conf = confusion(scored, by)
    long = conf.unpivot(by, ["tn", "fp", "fn", "tp"], "cell", "n")
    total = F.sum("n").over(Window.partitionBy(*by))
    return long.select(*by, "cell", "n", (F.lit(100.0) * F.col("n") / total).alias("pct"))


def model_deltas(report: DataFrame, base: str, other: str,
                 metrics: Sequence[str] = ("precision", "recall", "f1_score", "roc_auc"),
                 model_col: str = "model") -> DataFrame:
    """Per metric: base value, other value, difference and relative change
    (difference / max(base, 0.001))."""
    long = report.where(F.col(model_col).isin(base, other)).unpivot(
        [model_col], list(metrics), "metric", "value")
    g = long.groupBy("metric").agg(
        F.max(F.when(F.col(model_col) == base, F.col("value"))).alias("base_value"),
        F.max(F.when(F.col(model_col) == other, F.col("value"))).alias("other_value"))
    d = F.col("other_value") - F.col("base_value")
    return g.select("metric", "base_value", "other_value", d.alias("delta"),
                    (d / F.greatest(F.col("base_value"), F.lit(0.001))).alias("relative"))


def best_model(report: DataFrame, metric: str = "f1_score", order_col: str = "model_order",
               model_col: str = "model") -> DataFrame:
    """Model with the highest ``metric``; the earliest model wins ties."""
    r = report if order_col in report.columns else report.withColumn(order_col, F.lit(0))
    key = F.struct(F.col(metric), -F.col(order_col))
    return r.agg(F.max_by(model_col, key).alias("best_model"),
                 F.max(metric).alias("best_value")).withColumn("metric", F.lit(metric))
