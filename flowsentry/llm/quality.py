"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-grams: words and word pairs (A-Z lower-cased), and
runs of one to three word shapes (letter case, first and last character,
length).  Each n-gram indicator is scaled by the log ratio of its counts in
the two classes; on the scaled indicators a linear hinge-loss model is fitted
by dual coordinate descent, and its margins are mapped to 0..1 on rows kept
out of the fit.

The counts cover every labelled training row (added up in Spark).  Every
n-gram of ``MIN_ROWS`` rows or more has a log ratio of its own: single shapes
by number in an array, all others by 64-bit hash in sorted files below the
shared checkpoint folder, which tasks memory-map.  The linear model is fitted
on ``FIT_ROWS`` labelled rows, chosen by hash of the id.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import lm
from flowsentry.llm import textkit as T
from flowsentry.llm.jaccard import stored
from flowsentry.session import scratch_path

#: labelled rows of the linear fit, n-grams seen in fewer rows do not count
FIT_ROWS, MIN_ROWS, SMOOTH = 12_000, 4, 1.0
COST, EPOCHS, SEED, THRESHOLD = 1.0, 12, 5, 0.7
#: labels up to which the label side of the join is broadcast (16 bytes each)
BROADCAST_LABELS = 2_000_000
#: features a task gathers before it passes sums on
BUFFER = 1 << 22
#: n-grams of one file of the model
SHARD = 1 << 20

_KIND = np.zeros(256, np.uint64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
#: number of every edge character: four letter kinds and the other ASCII ones
_, _EDGE = np.unique(np.where(_KIND > 0, _KIND, np.arange(256) + 8), return_inverse=True)
EDGES, CASES, SIZES = int(_EDGE.max()) + 1, 6, 8
#: single shapes are numbered without gaps or collisions; the bias comes last
BIAS = EDGES * EDGES * CASES * SIZES


def shapes(w: T.Words) -> np.ndarray:
    """One number per word: edge characters, letter cases inside, length class."""
    if not len(w):
        return np.zeros(0, np.int64)
    kind = _KIND[w.buf]
    up = np.concatenate([[0], np.cumsum(kind == 1)])
    low = np.concatenate([[0], np.cumsum(kind == 2)])
    size = np.minimum((w.end - w.start) // 3, SIZES - 1)
    u, v = up[w.end] - up[w.start], low[w.end] - low[w.start]
    cases = np.minimum(u, 2) * 2 + (v > 0)
    return ((_EDGE[w.buf[w.start]] * EDGES + _EDGE[w.buf[w.end - 1]]) * CASES + cases) * SIZES + size


def features(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, single shape), sorted; every row has the bias."""
    both = np.unique(np.concatenate([w.doc << 20 | shapes(w), np.arange(w.rows) << 20 | BIAS]))
    return both >> 20, both & ((1 << 20) - 1)


def grams(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) of words, word pairs and runs of two and three
    shapes, sorted by key.  Keys are 64-bit hashes."""
    rows, keys = [], []
    raw, s = w.hashes_lower(), T.mix(shapes(w).astype(np.uint64))
    for h, k in ((raw, 1), (raw, 2), (s, 2), (s, 3)):
        if len(w) >= k:
            g = T.gram_hashes(h, k)
            same = w.doc[:len(g)] == w.doc[k - 1:]
            rows.append(w.doc[:len(g)][same])
            keys.append(g[same])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(key, kind="stable")  # rows of one n-gram stay in order
    row, key = row[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return row[new], key[new]


def _count(labelled: DataFrame) -> np.ndarray:
    """Rows per single shape and class over all labelled rows, shape (2, BIAS + 1)."""
    def run(batches):
        out = np.zeros((2, BIAS + 1), np.int64)
        for b in batches:
            y = b.column(1).to_numpy().astype(np.int64)
            for w in T.word_pieces(b.column(0), lower=False):
                row, f = features(w)
                np.add.at(out, (y[w.row0:w.row0 + w.rows][row], f), 1)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.ravel()[at])], ["key", "n"])

    def dense(batches):
        out = np.zeros(2 * (BIAS + 1), np.int64)
        for b in batches:
            out[b.column(0).to_numpy()] = b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["counts"])

    # at most 2 * (BIAS + 1) sums, whatever the corpus: one array of fixed size
    sums = labelled.select("t", "y").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    got = sums.coalesce(1).mapInArrow(dense, "counts binary").first()
    return np.frombuffer(got["counts"], np.int64).reshape(2, BIAS + 1) if got else np.zeros((2, BIAS + 1), np.int64)


def _count_grams(labelled: DataFrame) -> DataFrame:
    """``(key, neg, pos)``: rows per n-gram and class over all labelled rows."""
    def run(batches):
        held, size = [], 0

        def flush():
            key, y = (np.concatenate(x) for x in zip(*held))
            key, inverse = np.unique(key, return_inverse=True)
            pos = np.bincount(inverse, y, len(key)).astype(np.int64)
            neg = np.bincount(inverse, minlength=len(key)) - pos
            for i in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[i:i + (1 << 16)]) for x in (T.signed(key), neg, pos)], ["key", "neg", "pos"])

        for b in batches:
            y = b.column(1).to_numpy().astype(np.int8)
            for w in T.word_pieces(b.column(0), lower=False):
                row, key = grams(w)
                held.append((key, y[w.row0:w.row0 + w.rows][row]))
                size += len(key)
                if size >= BUFFER:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return labelled.select("t", "y").mapInArrow(run, "key long, neg long, pos long").groupBy("key").agg(
        F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))


def log_ratio(neg, pos, total) -> np.ndarray:
    """Scale of n-grams from their counts and the smoothed totals per class."""
    return np.log((pos + SMOOTH) / total[1]) - np.log((neg + SMOOTH) / total[0])


class Grams:
    """The n-grams of a model, read in a task: sorted keys and, by rank, the
    arrays ``ratio`` and ``weight``, in files by leading bits of the key."""

    def __init__(self, folder: str, bits: int, sizes):
        self.folder, self.vocab = folder, lm.Vocabulary(folder, bits, sizes)
        self.files = lru_cache(maxsize=None)(lambda name: lm.get(folder, name))

    def read(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of sorted ids, 0 where the id is -1."""
        out, off = np.zeros(len(ids)), self.vocab.offset
        at = np.flatnonzero(ids >= 0)
        cut = np.searchsorted(ids[at], off)
        for s in np.flatnonzero(np.diff(cut)):
            part = at[cut[s]:cut[s + 1]]
            out[part] = self.files(f"{name}-{s}")[ids[part] - off[s]]
        return out

    def write(self, name: str, ids: np.ndarray, values: np.ndarray) -> None:
        """Whole arrays with ``values`` at sorted ids, 0 elsewhere."""
        off = self.vocab.offset
        cut = np.searchsorted(ids, off)
        for s in np.flatnonzero(np.diff(off)):
            a = np.zeros(off[s + 1] - off[s])
            a[ids[cut[s]:cut[s + 1]] - off[s]] = values[cut[s]:cut[s + 1]]
            lm.put(self.folder, f"{name}-{s}", a)


def _write_ratios(kept: DataFrame, size: int, total) -> tuple:
    """Model files of the n-grams ``(key, neg, pos)``: arguments of ``Grams``."""
    folder = scratch_path(kept.sparkSession, "quality")
    bits = int(np.ceil(np.log2(size / SHARD))) if size > SHARD else 0

    def write(batches):
        for tab in lm._grouped(batches, "shard"):
            s = tab.column("shard")[0].as_py()
            key, neg, pos = (tab.column(c).to_numpy() for c in ("key", "neg", "pos"))
            key = key.view(np.uint64)
            order = np.argsort(key)
            lm.put(folder, f"vocab-{s}", key[order])
            lm.put(folder, f"ratio-{s}", log_ratio(neg, pos, total)[order])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([len(key)], pa.int64())], ["s", "n"])

    shard = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    rows = kept.select(shard.alias("shard"), "key", "neg", "pos").repartition(1 << bits, "shard") \
        .sortWithinPartitions("shard").mapInArrow(write, "s long, n long").collect()
    sizes = np.zeros(1 << bits, np.int64)
    for r in rows:
        sizes[r["s"]] = r["n"]
    return folder, bits, sizes.tolist()


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = COST,
                            epochs: int = EPOCHS, seed: int = SEED) -> np.ndarray:
    """Weights (scaled features of unit length, labels -1 and 1) of the
    L2-regularised hinge loss."""
    x = []
    for f in rows:
        v = scale[f]
        x.append((f, v / np.linalg.norm(v)))
    w, a = np.zeros(len(scale)), np.zeros(len(rows))
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in r.permutation(len(rows)):
            f, v = x[i]
            g = y[i] * (w[f] @ v) - 1
            new = min(max(a[i] - g, 0.0), cost)
            if new != a[i]:
                worst = max(worst, abs(new - a[i]))
                w[f] += (new - a[i]) * y[i] * v
                a[i] = new
        if worst < 1e-3:
            break
    return w


def _margins(rows, weight, scale):
    return np.array([scale[f] @ weight[f] / np.linalg.norm(scale[f]) for f in rows])


def _calibrate(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins (Newton steps)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([(p - y) @ m + 1e-3 * a, (p - y).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[v @ (m * m) + 1e-3, v @ m], [v @ m, v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def fit_sample(rows: DataFrame, n: int, most: int) -> DataFrame:
    """The ``most`` of ``n`` rows with the smallest hash of their id.  A hash
    bound goes first, so that about that many texts move, however many tasks
    and rows there are; where many rows share ids it may be fewer."""
    share = min(1.0, (most + 12 * most ** 0.5 + 64) / max(n, 1))
    bound = min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))
    h = F.xxhash64("id")
    return rows.where(h <= F.lit(bound)).orderBy(h, "id").limit(most)


def train(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
          fit_rows: int = FIT_ROWS, min_rows: int = MIN_ROWS) -> dict:
    """Model of the labelled rows: scale and weight arrays, slope, offset.

    ``fit_rows`` bounds the rows of the linear fit; n-grams of fewer than
    ``min_rows`` labelled rows have no ratio (1: all have one).

    Rows whose label is not 0 or 1 are not read.  With fewer than one row of
    either class the model gives every text the share of label 1 (0.5 without
    rows).
    """
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    counts = _count(rows)
    n = counts[:, BIAS]
    if not n.min():
        return {"rest": float(n[1] / n.sum()) if n.sum() else 0.5}
    kept = stored(_count_grams(rows).where(F.col("neg") + F.col("pos") >= min_rows), "quality-grams")
    size, *sums = kept.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("neg", "pos"))).first()
    seen = counts.sum(axis=0) >= min_rows
    seen[BIAS] = False
    total = counts[:, seen].sum(axis=1) + np.array(sums) + SMOOTH * max(seen.sum() + size, 1)
    scale = np.where(seen, log_ratio(*counts, total), 0.0)
    scale[BIAS] = 1
    files = _write_ratios(kept, size, total)
    sample = fit_sample(rows, int(n.sum()), fit_rows)

    def fit(batches):
        table = Grams(*files)
        feats, y = [], []
        for b in batches:
            y.extend(b.column(2).to_pylist())
            for w in T.word_pieces(b.column(1), lower=False):
                row, f = features(w)
                own, key = grams(w)
                uniq, inverse = np.unique(key, return_inverse=True)
                ids = table.vocab.ids(uniq)[inverse]
                known = ids >= 0
                row, f = np.concatenate([row, own[known]]), np.concatenate([f, ids[known] + BIAS + 1])
                order = np.argsort(row, kind="stable")
                feats.extend(np.split(f[order], np.cumsum(np.bincount(row, minlength=w.rows))[:-1]))
        # numbers of the features that occur in the sample
        cut = np.cumsum([len(f) for f in feats])[:-1]
        used, feats = np.unique(np.concatenate(feats), return_inverse=True)
        feats = np.split(feats.astype(np.int32), cut)
        single = np.searchsorted(used, BIAS + 1)
        x = np.concatenate([scale[used[:single]], table.read("ratio", used[single:] - BIAS - 1)])
        feats = [f[x[f] != 0] for f in feats]
        y = np.array(y)
        sign = 2.0 * y - 1
        out = np.arange(len(y)) % 5 == 0
        part = dual_coordinate_descent([f for f, o in zip(feats, out) if not o], x, sign[~out])
        slope, offset = _calibrate(_margins([f for f, o in zip(feats, out) if o], part, x), y[out])
        w = dual_coordinate_descent(feats, x, sign)
        table.write("weight", used[single:] - BIAS - 1, w[single:])
        weight = np.zeros(BIAS + 1)
        weight[used[:single]] = w[:single]
        yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary()), pa.array([slope]), pa.array([offset])],
                                         ["weight", "slope", "offset"])

    got = sample.coalesce(1).mapInArrow(fit, "weight binary, slope double, offset double").first()
    return {"files": files, "scale": scale, "weight": np.frombuffer(got["weight"]), "slope": got["slope"],
            "offset": got["offset"]}


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: ``id_col`` and ``score`` (0 to 1, higher: label 1 is
    likelier).  Null and empty texts are scored by the bias alone."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    df = df.select(id_col, text)
    if "rest" in model:
        return df.select(id_col, F.lit(model["rest"]).alias("score"))
    schema = StructType([df.schema[id_col], StructField("score", DoubleType(), False)])
    shared = df.sparkSession.sparkContext.broadcast((model["scale"], model["weight"]))
    slope, offset, files = model["slope"], model["offset"], model["files"]

    def run(batches):
        scale, weight = shared.value
        table = Grams(*files)
        for b in batches:
            for w in T.word_pieces(b.column(1), lower=False):
                row, f = features(w)
                own, key = grams(w)
                uniq, inverse = np.unique(key, return_inverse=True)
                ids = table.vocab.ids(uniq)
                r, v = table.read("ratio", ids), table.read("weight", ids)
                s = scale[f]
                m = np.bincount(row, s * weight[f], w.rows) + np.bincount(own, (r * v)[inverse], w.rows)
                m /= np.sqrt(np.bincount(row, s * s, w.rows) + np.bincount(own, (r * r)[inverse], w.rows))
                p = 1 / (1 + np.exp(-np.clip(slope * m + offset, -700, 700)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.row0, w.rows), pa.array(p)], schema.names)

    return df.mapInArrow(run, schema)


def with_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """Rows of ``docs`` with one agreed label (ids with differing labels have none)."""
    one = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z").select("_id", F.col("_y").alias(label))
    few = labels.count() <= BROADCAST_LABELS
    return docs.drop(label).join(F.broadcast(one) if few else one, F.col(id_col) == F.col("_id")).drop("_id")


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of the whole table, learned from the training rows' labels."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(with_labels(docs.where(~held).select("doc_id", "text"), labels))
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
