"""Registered queries: scaler, Random Forest, Isolation Forest, sweeps and
the three-detector report (M1-M10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.operators import baselines as BL
from flowsentry.operators import evaluation as EV
from flowsentry.operators import forest as FR
from flowsentry.operators import isolation as IF
from flowsentry.operators import splits as S
from flowsentry.operators.scaling import ZScaler
from flowsentry.plans.catalog import query
from flowsentry.plans.common import D_AUC, D_FC, D_RATES, D_SPLIT, D_THR, D_THR_SCORED, D_WF, duck, split_windows, windows
from flowsentry.sources import bindings as B


def _split(spark, sf):
    """Windows with their split, materialised once (they feed several fits)."""
    return split_windows(spark, sf)


def _tt(s):
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test")


_Z = ", ".join(
    f"(cast({c} as double) - (SELECT avg(cast({c} as double)) FROM wf)) / "
    f"coalesce(nullif((SELECT stddev_pop(cast({c} as double)) FROM wf), 0), 1.0) AS z_{c}"
    for c in ("flow_count", "avg_duration", "avg_bytes"))


@query("zscale", duck(["flows"], D_FC, D_WF, select=f'SELECT "window", {_Z} FROM wf'),
       ["z_flow_count", "z_avg_duration", "z_avg_bytes"])
def q_zscale(spark, sf):
    """M1: population-std z-scores of the three window features."""
    w = windows(spark, sf)
    return ZScaler().fit(w).transform(w).select(
        "window", "z_flow_count", "z_avg_duration", "z_avg_bytes")


_FLAGS = "true AS score_in_range, true AS pred_follows_score"


def _by_rule(scored, cut: float):
    """Scored rows with their values replaced by the rules that every fit keeps."""
    return scored.select("model", "id", "label", F.col("score").between(0.0, 1.0).alias("score_in_range"),
                         ((F.col("pred") == 1) == (F.col("score") > F.lit(float(cut)))).alias("pred_follows_score"))


@query("forest_fit", duck(["flows"], D_FC, D_WF, *D_SPLIT, select="""SELECT count(*) AS n_train,
    count(*) FILTER (WHERE label = 1) AS n_attack, 100 AS num_trees, 10 AS max_depth, true AS nodes_in_bounds FROM tr"""))
def q_forest_fit(spark, sf):
    """M2: 100 trees, depth 10, min leaf 2 on the training windows; a tree has at
    least its root, at most 2 ** 11 - 1 nodes."""
    train, _ = _tt(_split(spark, sf))
    return FR.forest_summary(FR.fit_forest(train), train).select(
        "n_train", "n_attack", "num_trees", "max_depth",
        F.col("total_nodes").between(100, 100 * (2 ** 11 - 1)).alias("nodes_in_bounds"))


@query("forest_score", duck(["flows"], D_FC, D_WF, *D_SPLIT, select=f"""SELECT 'random_forest' AS model,
    "window" AS id, label, {_FLAGS} FROM te"""))
def q_forest_score(spark, sf):
    """M3: class and attack probability for the held-out windows: every window
    once, probabilities in [0, 1], the class follows the probability."""
    train, test = _tt(_split(spark, sf))
    return _by_rule(FR.score_forest(FR.fit_forest(train), test), 0.5)


@query("importances", duck(["flows"], D_FC, D_WF, *D_SPLIT, select="""SELECT
    unnest(['flow_count', 'avg_duration', 'avg_bytes']) AS feature, true AS not_negative, 1.0::DOUBLE AS sum_of_all,
    (SELECT count(*) FROM tr) > 0 AS trained"""), ["sum_of_all"])
def q_importances(spark, sf):
    """M4: feature importances: one per feature, none negative, adding up to 1."""
    train, _ = _tt(_split(spark, sf))
    imp = FR.importances(FR.fit_forest(train))
    return imp.crossJoin(F.broadcast(imp.agg(F.sum("importance").alias("sum_of_all")))).select(
        "feature", (F.col("importance") >= 0).alias("not_negative"), "sum_of_all", F.lit(True).alias("trained"))


@query("isolation_score", duck(["flows"], D_FC, D_WF, *D_SPLIT, select=f"""SELECT 'isolation_forest' AS model,
    "window" AS id, label, {_FLAGS} FROM te"""))
def q_isolation(spark, sf):
    """M5: Isolation Forest fitted on the scaled training windows
    (contamination 0.05), applied to the scaled test windows."""
    train, test = _tt(_split(spark, sf))
    sc = ZScaler().fit(train)
    feats = ["z_flow_count", "z_avg_duration", "z_avg_bytes"]
    model = IF.IsolationForest(features=feats, contamination=0.05).fit(sc.transform(train))
    return _by_rule(IF.score_isolation(model, sc.transform(test)), model.cut)


@query("contamination_sweep", duck(["scored"],
        ("cuts", f"""SELECT model, unnest([0.005, 0.01, 0.02, 0.05]::DOUBLE[]) AS contamination,
                    unnest(quantile_cont(score, [{", ".join(repr(1.0 - c) for c in (0.005, 0.01, 0.02, 0.05))}]))
                    AS cutoff FROM scored GROUP BY model"""),
        ("x", "SELECT model, contamination, cutoff, label, cast(score > cutoff as int) AS pred FROM scored JOIN cuts USING (model)"),
        select="""SELECT model, contamination, cutoff,
            CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0.0 END AS precision,
            CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0.0 END AS recall,
            CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0.0 END AS f1_score, tp, fp, fn, tn FROM (
          SELECT model, contamination, cutoff,
            count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label <> 1 AND pred = 1) AS fp,
            count(*) FILTER (WHERE label = 1 AND pred <> 1) AS fn, count(*) FILTER (WHERE label <> 1 AND pred <> 1) AS tn
          FROM x GROUP BY model, contamination, cutoff) c"""),
       ["contamination", "cutoff", "precision", "recall", "f1_score"])
def q_contamination_sweep(spark, sf):
    """M9: contamination levels applied to one pass of given scores."""
    sc = B.scored(spark, sf)
    return IF.contamination_sweep(sc, sc)


@query("cv_f1", duck(["flows"], D_FC, D_WF, select="""SELECT fold, count(*) AS n, true AS f1_in_range,
    true AS mean_of_folds, true AS std_of_folds FROM (SELECT cast((row_number() OVER (PARTITION BY label
      ORDER BY md5(concat('42:', cast("window" as varchar))), "window") - 1) % 5 as int) AS fold FROM wf) k GROUP BY fold"""))
def q_cv(spark, sf):
    """M7: 5-fold stratified CV F1 of the forest (200 trees, unlimited depth):
    fold sizes, F1 in [0, 1], mean and population std of the folds."""
    w = windows(spark, sf).checkpoint(eager=True)
    cv = FR.cross_validate(w, k=5)
    own = cv.agg(F.avg("f1").alias("m"), F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col("f1") * F.col("f1"))
                                                          - F.avg("f1") * F.avg("f1"))).alias("s"))
    return cv.crossJoin(F.broadcast(own)).select(
        "fold", "n", F.col("f1").between(0.0, 1.0).alias("f1_in_range"),
        (F.abs(F.col("mean_f1") - F.col("m")) < 1e-9).alias("mean_of_folds"),
        (F.abs(F.col("std_f1") - F.col("s")) < 1e-6).alias("std_of_folds"))


_REPORT = ["precision", "recall", "f1_score", "roc_auc", "fpr", "fnr"]


def _report_rules(report, *by_value: str):
    """A report's rows: sizes, whether the rates follow from the counts, and the
    values themselves for models that SQL can compute."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    near = lambda c, up, low: F.abs(F.col(c) * low - up) < 1e-6
    follow = near("precision", tp, tp + fp) & near("recall", tp, tp + fn) & near("fpr", fp, fp + tn) \
        & near("fnr", fn, fn + tp) & near("f1_score", 2 * tp, 2 * tp + fp + fn) & F.col("roc_auc").between(0.0, 1.0)
    exact = F.col("model").isin(*by_value) if by_value else F.lit(False)
    return report.select("model", (tp + fp + fn + tn).alias("n"), (tp + fn).alias("n_attack"), follow.alias("rates_follow"),
                         *[F.when(exact, F.col(c)).alias(c) for c in _REPORT])


_SIZES = """SELECT m.model, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_attack FROM te,
    (SELECT unnest([{models}]) AS model) m GROUP BY m.model"""
_NULLS = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in _REPORT)


@query("warmup_protocol", duck(["flows"], D_FC, D_WF, *D_SPLIT,
        ("sz", _SIZES.format(models="'isolation_forest', 'random_forest'")),
        select=f"SELECT model, n, n_attack, true AS rates_follow, {_NULLS} FROM sz"), _REPORT)
def q_warmup_protocol(spark, sf):
    """M8: scaler + Isolation Forest fitted on the 10 % benign warm-up; the
    forest trained on all training windows under the warm-up scaler."""
    s = _split(spark, sf)
    train, test = _tt(s)
    warm = S.warmup_fraction(s, 0.1)
    sc = ZScaler().fit(warm)
    feats = ["z_flow_count", "z_avg_duration", "z_avg_bytes"]
    iso = IF.IsolationForest(features=feats, contamination=0.05).fit(sc.transform(warm))
    iso_scored = IF.score_isolation(iso, sc.transform(test))
    rf = FR.fit_forest(sc.transform(train), features=feats)
    rf_scored = FR.score_forest(rf, sc.transform(test))
    return _report_rules(EV.evaluation_report(iso_scored.unionByName(rf_scored)))


@query("evaluation_report", duck(["flows"], D_FC, D_WF, *D_SPLIT, D_THR, D_THR_SCORED,
        ("rates", D_RATES.format(by="model", src="ts_scored")), ("auc", D_AUC.format(src="ts_scored")),
        ("sz", _SIZES.format(models="'threshold', 'isolation_forest', 'random_forest'")),
        select=f"""SELECT sz.model, sz.n, sz.n_attack, true AS rates_follow, {", ".join(_REPORT)}
                   FROM sz LEFT JOIN rates USING (model) LEFT JOIN auc USING (model)"""), _REPORT)
def q_evaluation_report(spark, sf):
    """Threshold, Isolation Forest and Random Forest on one test set; the
    threshold detector's row by value."""
    s = _split(spark, sf)
    train, test = _tt(s)
    thr = BL.sigma_detector(train, test, 2.0)
    sc = ZScaler().fit(train)
    feats = ["z_flow_count", "z_avg_duration", "z_avg_bytes"]
    iso = IF.IsolationForest(features=feats, contamination=0.05).fit(sc.transform(train))
    iso_scored = IF.score_isolation(iso, sc.transform(test))
    rf_scored = FR.score_forest(FR.fit_forest(train), test)
    return _report_rules(EV.evaluation_report(thr.unionByName(iso_scored).unionByName(rf_scored)), "threshold")


_INV = """SELECT m.model, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_attack, true AS scores_in_range,
    true AS pred_follows_score, true AS cells_add_up FROM te, (SELECT unnest(['isolation_forest', 'random_forest']) AS model) m
    GROUP BY m.model"""


@query("model_invariants", duck(["flows"], D_FC, D_WF, *D_SPLIT, select=_INV))
def q_model_invariants(spark, sf):
    """M3 + M5: both forests score every test window once, within [0, 1], their
    predictions follow the score, and their confusion cells add up to the rows."""
    train, test = _tt(_split(spark, sf))
    sc = ZScaler().fit(train)
    feats = ["z_flow_count", "z_avg_duration", "z_avg_bytes"]
    model = IF.IsolationForest(features=feats, contamination=0.05).fit(sc.transform(train))
    iso = IF.score_isolation(model, sc.transform(test)).withColumn("rule", F.col("score") > F.lit(model.cut))
    rf = FR.score_forest(FR.fit_forest(train), test).withColumn("rule", F.col("score") > 0.5)
    both = iso.unionByName(rf)
    n, pos = F.count(F.lit(1)), F.count_if(F.col("label") == 1)
    cells = [F.count_if((F.col("label") == y) & (F.col("pred") == p)) for y in (0, 1) for p in (0, 1)]
    return both.groupBy("model").agg(
        n.alias("n"), pos.alias("n_attack"),
        F.bool_and(F.col("score").between(0.0, 1.0)).alias("scores_in_range"),
        F.bool_and((F.col("pred") == 1) == F.col("rule")).alias("pred_follows_score"),
        ((cells[0] + cells[1] + cells[2] + cells[3] == n) & (cells[2] + cells[3] == pos)).alias("cells_add_up"))
