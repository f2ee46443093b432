"""Isolation Forest (Liu, Ting, Zhou, ICDM 2008) on Spark (M5, M8, M9).

Fit
  * every tree takes the ``psi`` rows of the whole table with the smallest
    hash of (seed, tree, row): independent samples without replacement, the
    same for any partitioning.  One pass; a row is passed on for a tree only if
    its hash is among the expected smallest, so about two rows move per drawn one;
  * ``groupBy(tree).applyInPandas`` grows the trees in parallel (psi <= 256
    rows per group) and emits flat node rows ``(tree, node, feature, split,
    left, right, size, depth)``.
Score
  * the node table is bounded (trees * (2 psi - 1) rows); it is collected
    once and broadcast, and an Arrow-batched pandas UDF walks every tree
    for a whole batch of rows with vectorised index arithmetic.
  * anomaly score s = 2^(-E[h(x)] / c(psi)); decision = cut - s where the
    cut is the (1 - contamination) quantile of the training scores, so a
    negative decision is an anomaly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.operators.prefix import small_side
from flowsentry.operators.stats import exact_quantiles
from flowsentry.session import ship_package
from flowsentry.operators.windows import FEATURES

EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = ("tree int, node int, feature int, split double, left int, right int, "
               "size long, depth int")


def avg_path_length(n):
    """c(n): average unsuccessful-search path length of a BST with n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[n == 2] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int):
    """Grow one isolation tree on ``x`` (rows x features); flat node arrays."""
    feat, split, left, right, size, depth = [], [], [], [], [], []

    def node(idx: np.ndarray, d: int) -> int:
        me = len(feat)
        feat.append(-1); split.append(0.0); left.append(-1); right.append(-1)
        size.append(len(idx)); depth.append(d)
        if d >= limit or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return me
        q = int(rng.choice(usable))
        p = float(rng.uniform(lo[q], hi[q]))
        go_left = sub[:, q] <= p
        feat[me], split[me] = q, p
        li = node(idx[go_left], d + 1)
        ri = node(idx[~go_left], d + 1)
        left[me], right[me] = li, ri
        return me

    node(np.arange(len(x)), 0)
    return feat, split, left, right, size, depth


def _fit_group(features: Sequence[str], seed: int, psi: int):
    limit = int(math.ceil(math.log2(max(psi, 2))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(list(features))[list(features)].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        f, s, l, r, n, d = _grow(x, rng, limit)
        return pd.DataFrame({"tree": tree, "node": np.arange(len(f), dtype=np.int32),
                             "feature": np.asarray(f, dtype=np.int32), "split": s,
                             "left": np.asarray(l, dtype=np.int32),
                             "right": np.asarray(r, dtype=np.int32),
                             "size": np.asarray(n, dtype=np.int64),
                             "depth": np.asarray(d, dtype=np.int32)})
    return fit


class IsolationForestModel:
    def __init__(self, nodes: DataFrame, features: Sequence[str], psi: int,
                 contamination: float, cut: float | None = None):
        self.nodes = nodes
        self.features = list(features)
        self.psi = psi
        self.contamination = contamination
        self.cut = cut
        self._bc = None

    # -- scoring ----------------------------------------------------------
    def _arrays(self):
        if self._bc is None:
            pdf = self.nodes.toPandas()  # bounded: trees * (2 psi - 1) rows
            trees = []
            for _, g in pdf.sort_values(["tree", "node"]).groupby("tree"):
                trees.append(tuple(g[c].to_numpy() for c in
                                   ("feature", "split", "left", "right", "size", "depth")))
            spark = self.nodes.sparkSession
            self._bc = spark.sparkContext.broadcast(trees)
        return self._bc

    def score(self, df: DataFrame, out: str = "anomaly_score") -> DataFrame:
        """Add ``anomaly_score`` in (0, 1]; higher is more anomalous."""
        ship_package(df.sparkSession)
        bc = self._arrays()
        denom = float(avg_path_length([self.psi])[0])

        @F.pandas_udf(T.DoubleType())
        def iso_score(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            total = np.zeros(len(x))
            rows = np.arange(len(x))
            for feat, split, left, right, size, depth in bc.value:
                idx = np.zeros(len(x), dtype=np.int64)
                while True:
                    f = feat[idx]
                    inner = f >= 0
                    if not inner.any():
                        break
                    xv = x[rows, np.where(inner, f, 0)]
                    nxt = np.where(xv <= split[idx], left[idx], right[idx])
                    idx = np.where(inner, nxt, idx)
                total += depth[idx] + avg_path_length(size[idx])
            mean_h = total / len(bc.value)
            return pd.Series(np.power(2.0, -mean_h / denom))

        return df.withColumn(out, iso_score(*[F.col(c).cast("double") for c in self.features]))

    def decide(self, scored: DataFrame, score: str = "anomaly_score") -> DataFrame:
        """Add ``decision`` (= cut - score, < 0 is an anomaly) and ``pred``."""
        d = scored.withColumn("decision", F.lit(float(self.cut)) - F.col(score))
        return d.withColumn("pred", (F.col("decision") < 0).cast("int"))


class IsolationForest:
    def __init__(self, features: Sequence[str] = FEATURES, trees: int = 100,
                 max_samples: int = 256, contamination: float = 0.05, seed: int = 42,
                 exact_cut: bool = True, key: Sequence[str] = ("window",)):
        self.features = list(features)
        self.trees = trees
        self.max_samples = max_samples
        self.contamination = contamination
        self.seed = seed
        self.exact_cut = exact_cut
        self.key = list(key)

    def fit(self, df: DataFrame) -> IsolationForestModel:
        ship_package(df.sparkSession)
        # rows are drawn by their key (unique per row), or by value without one
        key = [F.col(c) for c in self.key if c in df.columns] or [F.col(c) for c in self.features]
        x = df.select(*[F.col(c).cast("double").alias(c) for c in self.features], F.xxhash64(*key).alias("_row"))
        n = x.count()
        psi = int(min(self.max_samples, n))
        # every tree takes the psi rows with the smallest hash of (seed, tree,
        # row values): its own sample of all rows, whatever the partitions.  A
        # row is passed on for a tree only if its hash is among the smallest
        # (psi + 12 sqrt(psi) + 64) / n expected ones, so about trees * 2 psi rows move.
        share = min(1.0, (psi + 12 * psi ** 0.5 + 64) / max(n, 1))
        draw = lambda t: F.pmod(F.xxhash64(F.lit(self.seed), t, F.col("_row")), F.lit(1 << 53)) / F.lit(float(1 << 53))
        trees = F.filter(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: draw(t) <= F.lit(share))
        cand = x.withColumn("tree", F.explode(trees)).withColumn("_h", draw(F.col("tree")))
        w = Window.partitionBy("tree").orderBy("_h", *self.features)
        chosen = cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi).drop("_r", "_h", "_row")
        nodes = chosen.groupBy("tree").applyInPandas(
            _fit_group(self.features, self.seed, psi), NODE_SCHEMA)
        nodes = nodes.checkpoint(eager=True)  # fixed forest: later reads see the same trees
        model = IsolationForestModel(nodes, self.features, psi, self.contamination)
        train_scores = model.score(x)
        q = 1.0 - self.contamination
        if self.exact_cut:
            cut = exact_quantiles(train_scores, "anomaly_score", [q]).first()["q0"]
        else:
            cut = train_scores.agg(F.percentile_approx("anomaly_score", F.lit(q), 100000)).first()[0]
        model.cut = float(cut)  # one number reaches the driver
        return model


def score_isolation(model: IsolationForestModel, df: DataFrame, key: str = "window",
                    name: str = "isolation_forest") -> DataFrame:
    """Scored rows: score = anomaly score (negated decision), pred from the cut."""
    s = model.decide(model.score(df))
    return s.select(F.lit(name).alias("model"), F.col(key).cast("bigint").alias("id"),
                    F.col("label").cast("int").alias("label"),
                    F.col("anomaly_score").alias("score"), "pred")


def contamination_sweep(train_scores: DataFrame, test_scored: DataFrame,
                        contaminations: Sequence[float] = (0.005, 0.01, 0.02, 0.05),
                        by: Sequence[str] = ("model",), exact: bool = True) -> DataFrame:
    """One score pass, many contamination levels: cut_c = (1 - c) quantile
    of the training scores; pred = score > cut_c; rates per level.

    No refit is needed: the trees do not depend on the contamination.  The
    cut-offs are one wide row per model joined to the scored rows, and every
    level is a conditional count in the same aggregate.
    """
    from flowsentry.operators.evaluation import _rates_long
    by = list(by)
    probs = [1.0 - c for c in contaminations]
    if exact:
        cuts = exact_quantiles(train_scores, "score", probs, by) \
            .select(*by, *[F.col(f"q{i}").alias(f"cutoff_{i}") for i in range(len(probs))])
    else:
        q = train_scores.groupBy(*by).agg(F.percentile_approx("score", probs, 100000).alias("_q"))
        cuts = q.select(*by, *[F.element_at("_q", i + 1).alias(f"cutoff_{i}")
                               for i in range(len(probs))])
    x = test_scored.join(small_side(cuts), by) if by else test_scored.crossJoin(F.broadcast(cuts))
    pos = F.col("label") == 1
    aggs = []
    for i in range(len(probs)):
        pp = F.col("score") > F.col(f"cutoff_{i}")
        aggs += [F.first(f"cutoff_{i}").alias(f"cutoff_{i}"),
                 F.count_if(pos & pp).alias(f"tp_{i}"), F.count_if(~pos & pp).alias(f"fp_{i}"),
                 F.count_if(pos & ~pp).alias(f"fn_{i}"), F.count_if(~pos & ~pp).alias(f"tn_{i}")]
    wide = x.groupBy(*by).agg(*aggs)
    rates = _rates_long(wide, by, contaminations, "contamination", extra=["cutoff"])
    return rates.select(*by, "contamination", "cutoff", "precision", "recall", "f1_score",
                        "tp", "fp", "fn", "tn")


def save_isolation(model: IsolationForestModel, path: str) -> None:
    """Persist the forest (node table, parquet) and its parameters (JSON row)."""
    import json
    model.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    params = {"features": model.features, "psi": model.psi,
              "contamination": model.contamination, "cut": model.cut}
    spark = model.nodes.sparkSession
    spark.createDataFrame([(json.dumps(params),)], "params string") \
         .write.mode("overwrite").json(f"{path}/params")


def load_isolation(spark, path: str) -> IsolationForestModel:
    import json
    p = json.loads(spark.read.json(f"{path}/params").first()["params"])
    nodes = spark.read.parquet(f"{path}/nodes")
    return IsolationForestModel(nodes, p["features"], p["psi"], p["contamination"], p["cut"])
