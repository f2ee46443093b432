"""Offline training run: flows -> clean -> windows -> split -> forest ->
held-out report -> persisted detector with its run metadata.

Only one-row aggregates (sizes, class counts, the report of one model)
reach the driver, for the metadata record.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.operators.cleaning import clean_flows, rebase, validate_flows
from flowsentry.operators.evaluation import evaluation_report
from flowsentry.operators.forest import fit_forest, save_detector, score_forest
from flowsentry.operators.splits import stratified_split
from flowsentry.operators.windows import FEATURES, window_features


def train_detector(raw_flows: DataFrame, window_s: float, model_path: str,
                   test_frac: float = 0.3, seed: int = 42, **forest_kw):
    """Returns ``(model, report)``; the model and metadata are saved under
    ``model_path``."""
    flows = rebase(clean_flows(raw_flows))
    gate = validate_flows(flows)
    windows = window_features(flows, window_s).checkpoint(eager=True)
    split = stratified_split(windows, "label", "window", test_frac, seed).checkpoint(eager=True)
    train, test = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
    model = fit_forest(train, seed=seed, **forest_kw)
    report = evaluation_report(score_forest(model, test))
    sizes = split.groupBy().agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.count_if(F.col("label") == 1).alias("n_attack_windows"),
        F.count(F.lit(1)).alias("n_windows")).first().asDict()
    rep = report.first().asDict()
    meta = {"trained_at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"),
            "window_seconds": window_s, "features": list(FEATURES), "seed": seed,
            "n_flows": gate["n_rows"], "n_valid_flows": gate["n_valid"], **sizes,
            **{k: rep[k] for k in ("precision", "recall", "f1_score", "roc_auc", "fpr", "fnr")}}
    save_detector(model, model_path, meta)
    return model, report
