"""Random Forest detector on MLlib.

Tree models are invariant to the z-scaling the reference applies first
(MLlib bins by quantiles, which an increasing affine map preserves), so
the pipeline feeds raw features.  ``minInstancesPerNode`` carries the leaf
minimum; the least size of a split node is applied to the node table of a
fitted forest (``stages.ForestStage``).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.operators.windows import FEATURES

# Fixed values (the reference's forest settings)
RF_TREES = 100
RF_DEPTH = 10
RF_MIN_LEAF = 2
RF_SEED = 42
CV_TREES = 200
CV_DEPTH = 30  # "unlimited" depth, capped at MLlib's maximum


def forest_pipeline(features: Sequence[str] = FEATURES, trees: int = RF_TREES,
                    depth: int = RF_DEPTH, min_leaf: int = RF_MIN_LEAF, seed: int = RF_SEED,
                    max_bins: int = 128, label: str = "label") -> Pipeline:
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    rf = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed,
        maxBins=max_bins, bootstrap=True, impurity="gini")
    return Pipeline(stages=[asm, rf])


def fit_forest(train: DataFrame, **kw) -> PipelineModel:
    t = train.withColumn("label", F.col("label").cast("double"))
    return forest_pipeline(**kw).fit(t)


def score_forest(model: PipelineModel, df: DataFrame, key: str = "window",
                 name: str = "random_forest") -> DataFrame:
    """Scored rows: pred = arg-max class (a 0.5 tie goes to 0), score = P(attack)."""
    out = model.transform(df)
    return out.select(F.lit(name).alias("model"), F.col(key).cast("bigint").alias("id"),
                      F.col("label").cast("int").alias("label"),
                      vector_to_array("probability")[1].alias("score"),
                      F.col("prediction").cast("int").alias("pred"))


def importances(model: PipelineModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """Feature importances, largest first (one row per feature)."""
    rf = model.stages[-1]
    vals = rf.featureImportances.toArray().tolist()
    s = SparkSession.getActiveSession()
    df = s.createDataFrame([(f, float(v)) for f, v in zip(features, vals)],
                           "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature")


def forest_summary(model: PipelineModel, train: DataFrame) -> DataFrame:
    rf = model.stages[-1]
    g = train.agg(F.count(F.lit(1)).alias("n_train"),
                  F.count_if(F.col("label") == 1).alias("n_attack"))
    return g.select("n_train", "n_attack", F.lit(rf.getNumTrees).alias("num_trees"),
                    F.lit(rf.getOrDefault("maxDepth")).alias("max_depth"),
                    F.lit(int(rf.totalNumNodes)).alias("total_nodes"))


def cross_validate(df: DataFrame, folds: DataFrame | None = None, k: int = 5,
                   trees: int = CV_TREES, depth: int = CV_DEPTH, seed: int = RF_SEED,
                   key: str = "window", parallelism: int = 5) -> DataFrame:
    """k-fold F1 of the attack class; folds from ``splits.kfold``.

    One table of assembled rows, kept for all folds; ``parallelism`` folds are
    fitted at a time, as jobs of the same session side by side, each over all
    rows but its own fold's.  Rows never leave the cluster.  Returns one row per
    fold (``fold, n, f1``) plus mean / population std; a fold without rows has
    F1 0 like one without hits.
    """
    from flowsentry.operators.splits import kfold
    f = folds if folds is not None else kfold(df, "label", key, k, seed)
    spark = df.sparkSession
    stages = forest_pipeline(trees=trees, depth=depth, seed=seed).getStages()
    table = stages[0].transform(f.withColumn("label", F.col("label").cast("double"))).select("label", "fold", "features")
    table = table.persist()

    def one(i: int):
        model = stages[1].fit(table.where(F.col("fold") != i))
        pred = model.transform(table.where(F.col("fold") == i))
        hit, said, real = pred.agg(F.count_if((F.col("prediction") == 1) & (F.col("label") == 1)),
                                   F.count_if(F.col("prediction") == 1), F.count_if(F.col("label") == 1)).first()
        n = table.where(F.col("fold") == i).count()
        return i, n, 2.0 * hit / (said + real) if said + real else 0.0
    try:
        table.count()  # filled once, before the folds read it side by side
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, k))) as pool:
            rows = list(pool.map(inheritable_thread_target(spark)(one), range(k)))
    finally:
        table.unpersist()
    out = spark.createDataFrame(rows, "fold int, n long, f1 double")
    summ = out.agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"))
    return out.crossJoin(summ)


def save_detector(model: PipelineModel, path: str, metadata: dict) -> None:
    """Pipeline (assembler keeps the ordered feature list) + run metadata."""
    model.write().overwrite().save(f"{path}/pipeline")
    s = SparkSession.getActiveSession()
    s.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string") \
     .write.mode("overwrite").json(f"{path}/metadata")


def load_detector(path: str) -> tuple[PipelineModel, dict]:
    s = SparkSession.getActiveSession()
    model = PipelineModel.load(f"{path}/pipeline")
    meta = json.loads(s.read.json(f"{path}/metadata").first()["metadata"])
    return model, meta
