"""Detector parts as pipeline stages.

``ZScale``, ``IsolationStage`` and ``ForestStage`` are estimators with params;
their models are transformers that ``PipelineModel`` saves and loads, so scaler
and detector travel as one object.  A scaler's model is a list of means and
scales in its params (plain column arithmetic when it transforms); the forests'
models are node tables (parquet), bounded by trees times nodes a tree.  All
transforms are row by row and work on batch and streaming frames alike.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCols, HasPredictionCol, HasSeed
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
    MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.operators.isolation import IsolationForest, IsolationForestModel
from flowsentry.operators.windows import FEATURES
from flowsentry.session import scratch_path, ship_package

Z_FEATURES = tuple(f"z_{c}" for c in FEATURES)
# Fixed value (the reference's forest setting): rows a node needs to be split
MIN_SPLIT = 5

NODE_SCHEMA = ("tree int, node int, parent int, feature int, split double, left int, right int, n long, "
               "value double, gain double, weight double")


# ----------------------------------------------------------------------------
# scaler
# ----------------------------------------------------------------------------

class ZScale(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """z-scores with the population deviation; a constant column keeps scale 1.

    Fit is one aggregate.  Null values are left out of it and stay null; a
    column without any value raises."""

    @keyword_only
    def __init__(self, *, inputCols=list(FEATURES), outputCols=list(Z_FEATURES)):
        super().__init__()
        self._set(inputCols=list(inputCols), outputCols=list(outputCols))

    def _fit(self, dataset: DataFrame) -> "ZScaleModel":
        cols = self.getInputCols()
        x = [F.col(c).cast("double") for c in cols]
        row = dataset.agg(*[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
        mean, sd = row[:len(cols)], row[len(cols):]
        if any(m is None for m in mean):
            raise ValueError(f"no values to scale in {[c for c, m in zip(cols, mean) if m is None]}")
        return ZScaleModel(inputCols=cols, outputCols=self.getOutputCols(), means=[float(m) for m in mean],
                           scales=[float(s) if s else 1.0 for s in sd])


class ZScaleModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "mean of each input column", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "scale of each input column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, means=None, scales=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        new = {o: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, o, m, s in zip(
            self.getInputCols(), self.getOutputCols(), self.getOrDefault("means"), self.getOrDefault("scales"))}
        return dataset.withColumns(new)


# ----------------------------------------------------------------------------
# node tables
# ----------------------------------------------------------------------------

class _TableWriter(MLWriter):
    """Params as pipeline metadata, the node table beside them."""

    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.nodes.write.mode("overwrite").parquet(f"{path}/nodes")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.nodes = self.sparkSession.read.parquet(f"{path}/nodes")
        return stage


class _TableModel(Model, MLWritable, MLReadable):
    """A model whose state is a node table (``nodes``) besides its params."""

    nodes: DataFrame | None = None

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)

    def copy(self, extra=None):
        out = super().copy(extra)
        out.nodes = self.nodes
        return out


class _DetectorParams(HasInputCols, HasPredictionCol):
    scoreCol = Param(Params._dummy(), "scoreCol", "name of the score column", TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(scoreCol="score", predictionCol="pred", inputCols=list(Z_FEATURES))


# ----------------------------------------------------------------------------
# isolation forest
# ----------------------------------------------------------------------------

class _IsolationParams(_DetectorParams, HasSeed):
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    maxSamples = Param(Params._dummy(), "maxSamples", "most rows of a tree", TypeConverters.toInt)
    contamination = Param(Params._dummy(), "contamination", "share of training rows above the cut", TypeConverters.toFloat)
    keyCol = Param(Params._dummy(), "keyCol", "column that tells training rows apart", TypeConverters.toString)
    decisionCol = Param(Params._dummy(), "decisionCol", "name of the decision column", TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(trees=100, maxSamples=256, contamination=0.05, keyCol="window", decisionCol="decision", seed=42)


class IsolationStage(Estimator, _IsolationParams, DefaultParamsReadable, DefaultParamsWritable):
    """Isolation forest; adds score (0 to 1), decision (below 0: anomaly) and
    prediction.  The cut is the exact (1 - contamination) quantile of the
    training scores."""

    @keyword_only
    def __init__(self, *, inputCols=None, trees=None, maxSamples=None, contamination=None, keyCol=None, seed=None,
                 scoreCol=None, decisionCol=None, predictionCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "IsolationStageModel":
        get = self.getOrDefault
        fitted = IsolationForest(features=self.getInputCols(), trees=get("trees"), max_samples=get("maxSamples"),
                                 contamination=get("contamination"), seed=get("seed"), key=(get("keyCol"),)).fit(dataset)
        model = self._copyValues(IsolationStageModel())
        model._set(psi=fitted.psi, cut=fitted.cut)
        model.nodes = fitted.nodes
        return model


class IsolationStageModel(_TableModel, _IsolationParams):
    psi = Param(Params._dummy(), "psi", "rows a tree was grown from", TypeConverters.toInt)
    cut = Param(Params._dummy(), "cut", "score above which a row is an anomaly", TypeConverters.toFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        forest = IsolationForestModel(self.nodes, self.getInputCols(), get("psi"), get("contamination"), get("cut"))
        decision = F.lit(get("cut")) - F.col(get("scoreCol"))
        return forest.score(dataset, get("scoreCol")).withColumn(get("decisionCol"), decision) \
            .withColumn(get("predictionCol"), (decision < 0).cast("int"))


# ----------------------------------------------------------------------------
# random forest with a least node size
# ----------------------------------------------------------------------------

def forest_nodes(model) -> DataFrame:
    """Node table of a fitted MLlib forest (a pipeline's last stage or the stage
    itself): ``n`` training rows of the node's bag, ``value`` the attack class'
    share of them, ``feature`` -1 at a leaf, ``left`` taken where the feature is
    at most ``split``."""
    rf = model.stages[-1] if hasattr(model, "stages") else model
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "forest-nodes")
    rf.write().overwrite().save(path)
    d = F.col("nodeData")
    raw = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), d["id"].alias("node"), d["leftChild"].alias("left"), d["rightChild"].alias("right"),
        F.when(d["leftChild"] < 0, -1).otherwise(d["split"]["featureIndex"]).cast("int").alias("feature"),
        F.get(d["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("split"), d["rawCount"].alias("n"),
        (F.coalesce(F.get(d["impurityStats"], F.lit(1)), F.lit(0.0)) / F.aggregate(d["impurityStats"], F.lit(0.0), lambda a, x: a + x)).alias("value"),
        d["gain"].alias("gain"), F.aggregate(d["impurityStats"], F.lit(0.0), lambda a, x: a + x).alias("weight"))
    kids = raw.where("left >= 0").select(
        F.col("tree").alias("t"), F.col("node").alias("parent"), F.explode(F.array("left", "right")).alias("kid"))
    out = raw.join(kids, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("kid")), "left")
    return out.select(*[c.split()[0] for c in NODE_SCHEMA.split(", ")]).checkpoint(eager=True)


def collapse(nodes: DataFrame, min_split: int = MIN_SPLIT) -> DataFrame:
    """The node table of the forest that never splits a node of fewer than
    ``min_split`` rows: such nodes become leaves and what is below them goes.
    Rows only get fewer down a tree, so a node stays if its parent may be split;
    splits above are the same with and without the rule."""
    small = F.col("n") < min_split
    up = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"), F.col("n").alias("up_n"))
    kept = nodes.join(up, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("p")), "left") \
        .where(F.col("parent").isNull() | (F.col("up_n") >= min_split)).select(nodes["*"])
    return kept.withColumns({
        "feature": F.when(small, -1).otherwise(F.col("feature")), "left": F.when(small, -1).otherwise(F.col("left")),
        "right": F.when(small, -1).otherwise(F.col("right")), "split": F.when(~small, F.col("split"))}).checkpoint(eager=True)


def node_importances(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature, importance``, largest first: gains weighted by rows, added up
    per tree, each tree's sum made 1, then the mean over the trees made 1."""
    names = F.array(*[F.lit(f) for f in features])
    gain = nodes.where("feature >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("g"))
    trees = gain.groupBy("tree").agg(F.sum("g").alias("total")).where("total > 0")
    per = gain.join(trees, "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("total")).alias("g"))
    total = per.agg(F.sum("g").alias("sum"))  # one row
    every = nodes.sparkSession.range(len(features)).select(F.col("id").cast("int").alias("feature"))
    out = every.join(per, "feature", "left").crossJoin(F.broadcast(total))
    return out.select(F.element_at(names, F.col("feature") + 1).alias("feature"),
                      F.coalesce(F.col("g") / F.col("sum"), F.lit(0.0)).alias("importance")) \
        .orderBy(F.desc("importance"), "feature")


class _ForestParams(_DetectorParams, HasLabelCol, HasSeed):
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "greatest depth", TypeConverters.toInt)
    minLeaf = Param(Params._dummy(), "minLeaf", "least rows of a leaf", TypeConverters.toInt)
    minSplit = Param(Params._dummy(), "minSplit", "least rows of a node that is split", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(trees=100, depth=10, minLeaf=2, minSplit=MIN_SPLIT, seed=42, labelCol="label")


class ForestStage(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Random forest grown by MLlib with least leaf and least split sizes; adds
    score (mean attack share of the leaves) and prediction (score above 0.5)."""

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol=None, trees=None, depth=None, minLeaf=None, minSplit=None, seed=None,
                 scoreCol=None, predictionCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "ForestStageModel":
        from flowsentry.operators.forest import fit_forest
        get = self.getOrDefault
        grown = fit_forest(dataset.withColumn("label", F.col(get("labelCol"))), features=self.getInputCols(),
                           trees=get("trees"), depth=get("depth"), min_leaf=get("minLeaf"), seed=get("seed"))
        model = self._copyValues(ForestStageModel())
        model.nodes = collapse(forest_nodes(grown), get("minSplit"))
        return model


def walk(x: np.ndarray, feature, split, left, right) -> np.ndarray:
    """Leaf of every row of ``x`` in one tree (nodes numbered from 0)."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return at
        go = np.where(x[rows, np.where(inner, f, 0)] <= split[at], left[at], right[at])
        at = np.where(inner, go, at)


def dense_trees(nodes: pd.DataFrame) -> list:
    """Arrays of every tree with its nodes numbered from 0 (root first)."""
    out = []
    for _, g in nodes.sort_values(["tree", "node"]).groupby("tree"):
        ids = g["node"].to_numpy()
        place = lambda c: np.searchsorted(ids, np.maximum(g[c].to_numpy(), 0))
        out.append((g["feature"].to_numpy(), g["split"].to_numpy(dtype=float), place("left"), place("right"),
                    g["value"].to_numpy(dtype=float)))
    return out


class ForestStageModel(_TableModel, _ForestParams):
    def importances(self) -> DataFrame:
        return node_importances(self.nodes, self.getInputCols())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark = dataset.sparkSession
        ship_package(spark)
        # at most trees * (2 ** (depth + 1) - 1) nodes, whatever the data
        trees = spark.sparkContext.broadcast(dense_trees(self.nodes.toPandas()))

        @F.pandas_udf(T.DoubleType())
        def attack_share(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            total = np.zeros(len(x))
            for feature, split, left, right, value in trees.value:
                total += value[walk(x, feature, split, left, right)]
            return pd.Series(total / len(trees.value))

        score, pred = self.getOrDefault("scoreCol"), self.getOrDefault("predictionCol")
        return dataset.withColumn(score, attack_share(*[F.col(c).cast("double") for c in self.getInputCols()])) \
            .withColumn(pred, (F.col(score) > 0.5).cast("int"))


# ----------------------------------------------------------------------------
# detectors
# ----------------------------------------------------------------------------

def detector_pipeline(kind: str = "isolation_forest", features: Sequence[str] = FEATURES, **settings) -> Pipeline:
    """Scaler and detector (``isolation_forest`` or ``random_forest``) as one
    pipeline; fit it, save it, and load it with ``PipelineModel.load``."""
    scaled = [f"z_{c}" for c in features]
    scaler = ZScale(inputCols=list(features), outputCols=scaled)
    stage = {"isolation_forest": IsolationStage, "random_forest": ForestStage}[kind]
    return Pipeline(stages=[scaler, stage(inputCols=scaled, **settings)])
