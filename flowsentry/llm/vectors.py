"""Embedding near-duplicates by Euclidean p-stable hashing.

Equal vectors of one label are one class.  Normalised class vectors get one
bucket per table: the quantised values of ``WIDE`` Gaussian projections
(width ``STEP_W``).  Classes that share a bucket in any of ``TABLES`` tables
are compared by exact cosine in double precision.  A pair at the threshold
shares a bucket of one table with probability 0.29, so it is missed in all 20
with probability 0.001; closer pairs less.

A bucket is compared in blocks of ``BLOCK`` rows, so no task holds a large
bucket.  A pair counts only in the first table where it meets, and a block
passes on per-class link counts and a spanning set of its links, never all
pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import textkit as T
from flowsentry.llm.components import components
from flowsentry.llm.jaccard import stored
from flowsentry.llm.lm import _grouped

TABLES, WIDE, STEP_W, SEED, BLOCK = 20, 16, 4.0, 17, 1024


@lru_cache(maxsize=8)
def projections(dims: int):
    r = np.random.default_rng([SEED, dims])
    return r.standard_normal((dims, TABLES * WIDE)), r.uniform(0, STEP_W, TABLES * WIDE)


def bucket_hashes(x: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per row and table of unit vectors."""
    a, b = projections(x.shape[1])
    q = np.floor((x @ a + b) / STEP_W).astype(np.int64).reshape(len(x), TABLES, WIDE).view(np.uint64)
    h = np.zeros((len(x), TABLES), np.uint64)
    for j in range(WIDE):
        h = T.mix(h * np.uint64(3) + q[:, :, j] + np.uint64(j + 1))
    return h


def _matrix(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length as (row numbers, matrix)."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = np.diff(col.offsets.to_numpy())
    flat = col.values.to_numpy(zero_copy_only=False)[col.offsets[0].as_py():].astype(np.float64)
    at = np.cumsum(size) - size
    return [(rows, flat[at[rows][:, None] + np.arange(d)]) for d in np.unique(size)
            for rows in [np.flatnonzero(size == d)]]


def _hash_classes(classes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            h = np.zeros((b.num_rows, TABLES), np.uint64)
            for rows, x in _matrix(b.column(2)):
                n = np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
                x = x / n
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                h[rows] = bucket_hashes(x) ^ np.uint64(x.shape[1])
            lab = b.column(1).to_numpy().astype(np.uint64)[:, None]
            h = T.mix(h + lab * np.uint64(0x9E3779B97F4A7C15) + np.arange(TABLES, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0), T.long_lists(T.signed(h.reshape(-1)), np.full(b.num_rows, TABLES))],
                                             ["cid", "h"])

    return classes.select("cid", "label", "v").mapInArrow(run, "cid long, h array<long>")


def _compare(cells: DataFrame, threshold: float) -> DataFrame:
    """Per block: link counts ``(a, null, n)`` and spanning links ``(a, b, 0)``."""
    def run(batches):
        for tab in _grouped(batches, "cell"):
            side = tab.column("side").to_numpy()
            cid, copies = tab.column("cid").to_numpy(), tab.column("copies").to_numpy()
            t = tab.column("t")[0].as_py()
            h = tab.column("h").combine_chunks().flatten().to_numpy().reshape(len(cid), TABLES)
            links_x, links_y = [], []
            for rows, x in _matrix(tab.column("v")):
                x = x / np.abs(x).max(axis=1, keepdims=True)
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                left, right = np.flatnonzero(side[rows] < 2), np.flatnonzero(side[rows] != 1)
                both = side[rows[0]] == 0  # a block against itself
                i, j = np.nonzero((x[left] @ x[right].T) / (norm[left][:, None] * norm[right]) >= threshold)
                i, j = rows[left[i]], rows[right[j]]
                ok = cid[i] < cid[j] if both else cid[i] != cid[j]
                links_x.append(i[ok])
                links_y.append(j[ok])
            i, j = np.concatenate(links_x), np.concatenate(links_y)
            if not len(i):
                continue
            new = ~(h[i, :t] == h[j, :t]).any(axis=1) if t else np.ones(len(i), bool)
            n = np.bincount(i[new], copies[j[new]], len(cid)) + np.bincount(j[new], copies[i[new]], len(cid))
            root = np.arange(len(cid))
            while True:  # smallest row reachable inside the block
                low = np.minimum(root[i], root[j])
                nxt = root.copy()
                np.minimum.at(nxt, i, low)
                np.minimum.at(nxt, j, low)
                nxt = nxt[nxt]
                if (nxt == root).all():
                    break
                root = nxt
            got = np.flatnonzero(n > 0)
            tied = np.flatnonzero(root != np.arange(len(cid)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([cid[got], cid[tied]])),
                 pa.array(np.concatenate([np.zeros(len(got), np.int64), cid[root[tied]]]),
                          mask=np.arange(len(got) + len(tied)) < len(got)),
                 pa.array(np.concatenate([n[got], np.zeros(len(tied))]).astype(np.int64))], ["a", "b", "n"])

    return cells.mapInArrow(run, "a long, b long, n long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = 0.93) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row of ``df``.

    Only vectors of equal, non-null labels and equal length link.  A vector
    that is null, empty, zero or holds a null or non-finite component links
    with nothing.  Equal vectors always link.  Rows with a null id are kept
    and take part in no link.  Empty table: no rows.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.col(label).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                     F.when(fine, F.col(vector)).alias("v"))
    classes = rows.where("v is not null").groupBy("label", "v").agg(
        F.min("id").alias("cid"), F.count("*").alias("copies"))
    classes = stored(classes, "vec-classes")
    hashed = stored(_hash_classes(classes), "vec-hashes")
    thin = hashed.select("cid", F.posexplode("h").alias("t", "key"))
    sizes = thin.groupBy("key").agg(F.count("*").alias("m")).where("m > 1") \
        .select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"))
    thin = thin.join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    blocks = thin.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "t", "cid",
        F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).alias("side"))
    cells = blocks.join(classes.select("cid", "copies", "v"), "cid").join(hashed, "cid") \
        .repartition("cell").sortWithinPartitions("cell")
    found = stored(_compare(cells, threshold), "vec-links")
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "cid")
    comp = components(found.where("b is not null")).withColumnRenamed("id", "cid")
    per = classes.join(links, "cid", "left").join(comp, "cid", "left").select(
        "label", "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "cid").alias("component_id"))
    return rows.join(per, ["label", "v"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"))


ORACLE_SQL = """WITH RECURSIVE v AS (
  SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(c, e.vec_id) AS component_id,
  e.vec_id = coalesce(c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM link GROUP BY x) l ON e.vec_id = l.x
LEFT JOIN (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x) r ON e.vec_id = r.x"""
