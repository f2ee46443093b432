"""Registered queries: threshold detector and evaluation (A4-A9, A20, J3,
J5, M6, O3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.operators import baselines as BL
from flowsentry.operators import evaluation as EV
from flowsentry.plans.catalog import query
from flowsentry.plans.common import (
    D_AUC, D_FC, D_RATES, D_SPLIT, D_THR, D_THR_SCORED, D_WF, duck, train_test,
)
from flowsentry.functions.scalar import iso_label
from flowsentry.sources import bindings as B

_THR_CHAIN = (D_FC, D_WF, *D_SPLIT, D_THR)


def _thr_scored(spark, sf):
    train, test = train_test(spark, sf)
    return BL.sigma_detector(train, test, 2.0)


@query("sigma_threshold", duck(["flows"], *_THR_CHAIN, select="SELECT * FROM thr"),
       ["mean", "std", "threshold"])
def q_sigma_threshold(spark, sf):
    """A4: mean + 2 sample-std of benign training flow counts."""
    train, _ = train_test(spark, sf)
    return BL.sigma_threshold(train, 2.0)


@query("threshold_predictions", duck(["flows"], *_THR_CHAIN, D_THR_SCORED,
                                     select="SELECT * FROM ts_scored"), ["score"])
def q_thr_pred(spark, sf):
    """Strict '>' against the broadcast threshold."""
    return _thr_scored(spark, sf)


_RATE_DOUBLES = ["precision", "recall", "f1_score", "fpr", "fnr"]


@query("sigma_report", duck(["flows"], *_THR_CHAIN, D_THR_SCORED,
                            ("rates", D_RATES.format(by="model", src="ts_scored")),
                            ("auc", D_AUC.format(src="ts_scored")),
                            select="""SELECT model, precision, recall, f1_score, roc_auc, fpr, fnr, tp, tn, fp, fn
                                      FROM rates JOIN auc USING (model)"""),
       _RATE_DOUBLES + ["roc_auc"])
def q_sigma_report(spark, sf):
    """M6 + M10 for the threshold detector on the held-out split."""
    return EV.evaluation_report(_thr_scored(spark, sf))


@query("confusion", duck(["scored"], select="""SELECT model,
    count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp,
    count(*) FILTER (WHERE label <> 1 AND pred = 1) AS fp,
    count(*) FILTER (WHERE label = 1 AND pred <> 1) AS fn,
    count(*) FILTER (WHERE label <> 1 AND pred <> 1) AS tn FROM scored GROUP BY model"""))
def q_confusion(spark, sf):
    return EV.confusion(B.scored(spark, sf))


@query("detection_metrics", duck(["scored"], select=D_RATES.format(by="model", src="scored")),
       _RATE_DOUBLES)
def q_detection_metrics(spark, sf):
    return EV.detection_metrics(B.scored(spark, sf))


@query("roc_auc", duck(["scored"], select=D_AUC.format(src="scored")), ["roc_auc"])
def q_roc_auc(spark, sf):
    """Tie-aware AUC, two-level cumulative over distinct scores."""
    return EV.roc_auc(B.scored(spark, sf))


@query("roc_curve", duck(["scored"], ("g", """SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos,
        count(*) FILTER (WHERE label <> 1) AS neg FROM scored GROUP BY model, score"""),
        ("tot", "SELECT model, cast(sum(pos) as double) AS P, cast(sum(neg) as double) AS N FROM g GROUP BY model"),
        select="""SELECT model, threshold, CASE WHEN N > 0 THEN cum_neg / N END AS fpr,
            CASE WHEN P > 0 THEN cum_pos / P END AS tpr FROM (
          SELECT model, score AS threshold,
            sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
            sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_neg FROM g
          UNION ALL SELECT model, NULL, 0, 0 FROM tot) p JOIN tot USING (model)"""),
       ["threshold", "fpr", "tpr"])
def q_roc_curve(spark, sf):
    return EV.roc_curve(B.scored(spark, sf))


@query("threshold_sweep", duck(["scored"],
        ("th", "SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold"),
        ("x", "SELECT model, threshold, label, cast(score >= threshold as int) AS pred FROM scored, th"),
        ("rates", D_RATES.format(by="model, threshold", src="x")),
        ("auc", D_AUC.format(src="scored")),
        select="""SELECT model, threshold, precision, recall, f1_score, roc_auc
                  FROM rates JOIN auc USING (model)"""),
       ["threshold", "precision", "recall", "f1_score", "roc_auc"])
def q_threshold_sweep(spark, sf):
    """Nine probability thresholds, '>=' rule, one grouped pass."""
    return EV.threshold_sweep(B.scored(spark, sf))


@query("threshold_sweep_long", duck(["scored"],
        ("th", "SELECT i / 10000.0::DOUBLE AS threshold FROM range(1, 10001) r(i)"),
        ("g", """SELECT model, score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label <> 1) AS n
                 FROM scored GROUP BY ALL"""),
        ("c", """SELECT model, threshold, cast(sum(p) FILTER (WHERE score >= threshold) AS bigint) AS tp,
                 cast(sum(n) FILTER (WHERE score >= threshold) AS bigint) AS fp, cast(sum(p) AS bigint) AS np,
                 cast(sum(n) AS bigint) AS nn FROM g, th GROUP BY ALL"""),
        select="""SELECT model, threshold, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, np - coalesce(tp, 0) AS fn,
                  nn - coalesce(fp, 0) AS tn FROM c"""), ["threshold"])
def q_threshold_sweep_long(spark, sf):
    """Ten thousand thresholds in one pass."""
    levels = [i / 10000 for i in range(1, 10001)]
    return EV.sweep_counts(B.scored(spark, sf), levels).select("model", "threshold", "tp", "fp", "fn", "tn")


@query("anomaly_sign", duck(["scored"], select="""SELECT model, id, cast(score > 0.9 AS int) AS pred FROM scored"""))
def q_anomaly_sign(spark, sf):
    """A detector's sign (-1 anomaly, 1 normal) as a class."""
    sign = F.when(F.col("score") > 0.9, F.lit(-1)).otherwise(F.lit(1))
    return B.scored(spark, sf).withColumn("sign", sign).select("model", "id", iso_label("sign").alias("pred"))


@query("confusion_pct", duck(["scored"], ("c", """SELECT model,
    count(*) FILTER (WHERE label <> 1 AND pred <> 1) AS tn,
    count(*) FILTER (WHERE label <> 1 AND pred = 1) AS fp,
    count(*) FILTER (WHERE label = 1 AND pred <> 1) AS fn,
    count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp FROM scored GROUP BY model"""),
        select="""SELECT model, cell, n, 100.0 * n / sum(n) OVER (PARTITION BY model) AS pct
                  FROM (UNPIVOT c ON tn, fp, fn, tp INTO NAME cell VALUE n) u"""), ["pct"])
def q_confusion_pct(spark, sf):
    """A20."""
    return EV.confusion_pct(B.scored(spark, sf))


_D_REPORT = ("rep", "SELECT * FROM rates JOIN auc USING (model)")


@query("model_deltas", duck(["scored"], ("rates", D_RATES.format(by="model", src="scored")),
        ("auc", D_AUC.format(src="scored")), _D_REPORT,
        ("lng", "UNPIVOT (SELECT model, precision, recall, f1_score, roc_auc FROM rep) ON precision, recall, f1_score, roc_auc INTO NAME metric VALUE value"),
        select="""SELECT metric, base_value, other_value, other_value - base_value AS delta,
            (other_value - base_value) / greatest(base_value, 0.001) AS relative FROM (
          SELECT metric, max(value) FILTER (WHERE model = 'a') AS base_value,
                 max(value) FILTER (WHERE model = 'b') AS other_value FROM lng GROUP BY metric) g"""),
       ["base_value", "other_value", "delta", "relative"])
def q_model_deltas(spark, sf):
    """Model b against model a."""
    return EV.model_deltas(EV.evaluation_report(B.scored(spark, sf)), "a", "b")


@query("best_model", duck(["scored"], ("rates", D_RATES.format(by="model", src="scored")),
        ("auc", D_AUC.format(src="scored")), _D_REPORT,
        select="""SELECT arg_max(model, struct_pack(v := f1_score, o := -mo)) AS best_model,
                         max(f1_score) AS best_value, 'f1_score' AS metric
                  FROM (SELECT *, CASE model WHEN 'a' THEN 0 ELSE 1 END AS mo FROM rep) r"""),
       ["best_value"])
def q_best_model(spark, sf):
    """O3: best model by F1, the earlier model wins ties."""
    rep = EV.evaluation_report(B.scored(spark, sf)).withColumn(
        "model_order", F.when(F.col("model") == "a", 0).otherwise(1))
    return EV.best_model(rep, "f1_score")
