"""Interpolated modified Kneser-Ney model of order 2 or 3.

Training counts words, then runs of ``order`` words, in Spark; the model is a folder of
sorted arrays below the shared checkpoint folder, in shards whose number
grows with the corpus.  Scoring tasks memory-map the shards they touch, so no
part of the model passes through the driver and none is held in memory whole.

* ``vocab-*``: sorted 64-bit word hashes by leading bits; a word's id is its
  rank.  ``count-*`` its training count.
* ``pair-*``/``pairn-*``: sorted ``(context id << 32 | word id)`` and counts,
  by ranges of at most about twice ``PAIR_SHARD`` training tokens: a context
  with more than ``PAIR_SHARD`` is split by word id.  ``ctx-*``: per context of the range total and the
  numbers of followers seen once, twice, more often; those of a split context
  are added up when read.
* ``left-*``: per word the number of distinct contexts before it.

Order 3 counts triples and adds

* ``tri-*``/``trin-*``/``trix-*``: sorted ``(rank of the pair in its shard << 32
  | id of the word before it)``, counts up to 255, and places and values of
  larger ones; the pair counts are then numbers of distinct words before a pair.
* ``c3-*``/``c3t-*``/``c3w-*``: sorted contexts of two ids, their totals and
  backoff weights.

With c the count of the longest run and D its modified discount (1, 2, 3+),
``p(w|v) = (c - D(c)) / c(v.) + g(v) p(w|shorter v)``; the lower orders use the
numbers of distinct contexts the same way and end in ``1 / (V + 1)``, which is
also the share of all unknown words.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import textkit as T
from flowsentry.llm.jaccard import stored
from flowsentry.session import scratch_path

END = np.uint64(0x5E4D0F0F1B7C9A11)
#: tokens a task gathers before it adds equal ones up and passes them on
BUFFER = 1 << 21
#: words of a vocabulary shard, training tokens of a pair shard (about)
VOCAB_SHARD, PAIR_SHARD = 1 << 20, 1 << 22


# ---- model files ---------------------------------------------------------

def _local(folder: str) -> str | None:
    if re.match(r"file:/+", folder):
        return "/" + re.sub(r"^file:/+", "", folder)
    return folder if folder.startswith("/") else None


def _store(folder: str):
    """Arrow's file system of a remote folder (``s3a`` is its ``s3``)."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


def put(folder: str, name: str, a: np.ndarray) -> None:
    """Writes one array; complete files only appear under their final name, so
    a task that is lost or runs twice leaves a whole file."""
    path = _local(folder)
    part = f"{name}.{uuid.uuid4().hex}"
    if path:
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{part}", "wb") as f:
            np.save(f, a)
        os.replace(f"{path}/{part}", f"{path}/{name}.npy")
    else:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{part}") as f:
            np.save(f, a)
        store.move(f"{base}/{part}", f"{base}/{name}.npy")


def get(folder: str, name: str) -> np.ndarray:
    """Memory-maps one array.  From a remote store it is copied first; the copy
    loses its name at once, so it goes with the last task that maps it."""
    path = _local(folder)
    if path:
        return np.load(f"{path}/{name}.npy", mmap_mode="r")
    store, base = _store(folder)
    copy, own = tempfile.mkstemp(prefix="lm-", suffix=".npy")
    try:
        with store.open_input_stream(f"{base}/{name}.npy") as f, os.fdopen(copy, "wb") as out:
            while block := f.read(1 << 22):
                out.write(block)
        return np.load(own, mmap_mode="r")
    finally:
        os.remove(own)


# ---- tokens --------------------------------------------------------------

def tokens(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with ``END`` after each row, and the row of each."""
    per_doc = w.per_doc()
    at = np.cumsum(per_doc)
    return np.insert(w.hashes(), at, END), np.insert(w.doc, at, np.arange(w.rows))


class Vocabulary:
    def __init__(self, folder: str, bits: int, sizes):
        self.folder, self.bits = folder, bits
        self.offset = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.keys = lru_cache(maxsize=None)(lambda s: get(folder, f"vocab-{s}"))

    def __len__(self):
        return int(self.offset[-1])

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ranks of the hashes, -1 where unknown.  ``h`` is sorted."""
        out = np.full(len(h), -1, np.int64)
        shard = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        cut = np.searchsorted(shard, np.arange(len(self.offset)))
        for s in np.flatnonzero(np.diff(cut)):
            if self.offset[s + 1] == self.offset[s]:
                continue
            q, keys = h[cut[s]:cut[s + 1]], self.keys(int(s))
            at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
            out[cut[s]:cut[s + 1]] = np.where(keys[at] == q, at + self.offset[s], -1)
        return out


def _count_words(df: DataFrame) -> DataFrame:
    def run(batches):
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(T.signed(h[i:i + (1 << 16)])), pa.array(n[i:i + (1 << 16)].astype(np.int64))], ["h", "n"])

        for b in batches:
            for w in T.word_pieces(b.column(0)):
                held.append(tokens(w)[0])
                size += len(held[-1])
                if size >= BUFFER:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return df.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _grouped(batches, key: str):
    """Whole tables of equal ``key`` from sorted batches."""
    held = []
    for b in batches:
        k = b.column(key).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else []
        for i, c in enumerate(cuts):
            part = b.slice(c, (cuts[i + 1] if i + 1 < len(cuts) else len(k)) - c)
            if held and held[-1].column(key)[0].as_py() != k[c]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _discounts(n: np.ndarray) -> list[float]:
    """Modified discounts from the numbers of items seen 1 to 4 times; plain
    values where the estimate is not defined."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        if all(0 < x < k for x, k in zip(d, (1, 2, 3))):
            return d
    return [0.5, 1.0, 1.5]


def _cuts(first: int, n: np.ndarray, size: int, limit: int) -> np.ndarray:
    """Starts ``context id << 32 | word id`` of pair shards over the contexts
    ``first, first + 1, ...`` that come ``n`` times: at most ``2 * limit``
    tokens, or a part of one context.  Word ids are ranks of hashes, so equal
    ranges of them hold about equal parts of a context's followers."""
    parts = -(-n // limit)
    group = (np.cumsum(n) - n) // limit
    new = np.ones(len(n), bool)
    new[1:] = (group[1:] != group[:-1]) | (parts[1:] > 1) | (parts[:-1] > 1)
    out = [np.flatnonzero(new) + first << 32]
    for i in np.flatnonzero(parts > 1):
        k = min(int(parts[i]), size)
        out.append((first + i << 32) + np.arange(1, k) * size // k)
    return np.sort(np.concatenate(out))


def _narrow(n: np.ndarray) -> np.ndarray:
    return n.astype(np.uint32 if not len(n) or n.max() < 1 << 32 else np.uint64)


def _packed(a: np.ndarray) -> bytes:
    return bytes(pa.compress(np.ascontiguousarray(a).tobytes(), "zstd", asbytes=True))


def _unpacked(blob: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, "zstd"), kind)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal entries of sorted columns."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


TRIPLES = "shard long, keys binary, befores binary, counts binary, size long"
_OF = [f"{x}{i}" for x in "nm" for i in (1, 2, 3, 4)]
WRITTEN = "s long, w long, left long, " + ", ".join(f"{c} long" for c in _OF) + ", shard long, keys binary, stats binary, size long"


def _triple_blobs(df: DataFrame, vocab_args: tuple, size: int, bounds: np.ndarray) -> DataFrame:
    """Counts of triples per piece of the corpus, by pair shard of their last
    two words: pairs as differences, words before them, counts."""
    def run(batches):
        vocab, held, n_held = Vocabulary(*vocab_args), [], 0

        def flush():
            key, a = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((a, key))
            key, a = key[order], a[order]
            at = _groups(key, a)
            n = np.diff(np.append(at, len(key)))
            key, a = key[at], a[at]
            cut = np.append(np.searchsorted(key, bounds.astype(np.uint64)), len(key))
            for s in np.flatnonzero(np.diff(cut)):
                part = slice(cut[s], cut[s + 1])
                k = key[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int64()), pa.array([_packed(np.diff(k, prepend=np.uint64(0)))], pa.binary()),
                     pa.array([_packed(a[part])], pa.binary()), pa.array([_packed(n[part].astype(np.uint32))], pa.binary()),
                     pa.array([len(k)], pa.int64())], [c.split()[0] for c in TRIPLES.split(", ")])

        for b in batches:
            for w in T.word_pieces(b.column(0)):
                h, row = tokens(w)
                known, inverse = np.unique(h, return_inverse=True)
                ids = vocab.ids(known)[inverse].astype(np.uint64)
                one, two = _befores(ids, row, np.uint64(size))
                held.append((one << np.uint64(32) | ids, two.astype(np.uint32)))
                n_held += len(ids)
                if n_held >= BUFFER:
                    yield from flush()
                    held, n_held = [], 0
        if held:
            yield from flush()

    return df.mapInArrow(run, TRIPLES)


def _befores(ids: np.ndarray, row: np.ndarray, begin) -> tuple[np.ndarray, np.ndarray]:
    """Ids one and two places before each token of its row, ``begin`` outside."""
    out = []
    for k in (1, 2):
        b = np.full_like(ids, begin)
        b[k:] = np.where(row[k:] == row[:-k], ids[:-k], begin) if len(ids) > k else b[k:]
        out.append(b)
    return out[0], out[1]


def _write_triples(blobs: DataFrame, folder: str, bounds: np.ndarray, size: int) -> DataFrame:
    """Writes the triple, pair and context files of every pair shard; gives the
    words' left counts, counts of counts (``n*`` of pairs, ``m*`` of triples) and
    the contexts of two words with their followers, by shard of the context."""
    shards, names = len(bounds), [c.split()[0] for c in WRITTEN.split(", ")]

    def empty(n):
        return {c: pa.nulls(n, pa.binary() if c in ("keys", "stats") else pa.int64()) for c in names}

    def run(batches):
        for tab in _grouped(batches, "shard"):
            s, sizes = tab.column("shard")[0].as_py(), tab.column("size").to_pylist()
            each = lambda c, kind: [_unpacked(x, m, kind) for x, m in zip(tab.column(c).to_pylist(), sizes)]
            key = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in each("keys", np.uint64)])
            a, n = np.concatenate(each("befores", np.uint32)), np.concatenate(each("counts", np.uint32)).astype(np.int64)
            order = np.lexsort((a, key))
            key, a, n = key[order], a[order], n[order]
            at = _groups(key, a)
            key, a, n = key[at], a[at], np.add.reduceat(n, at)
            first = _groups(key)
            pair, more = key[first], np.diff(np.append(first, len(key)))
            rank = np.repeat(np.arange(len(pair), dtype=np.uint64), more)
            put(folder, f"tri-{s}", rank << np.uint64(32) | a)
            put(folder, f"trin-{s}", np.minimum(n, 255).astype(np.uint8))
            big = np.flatnonzero(n >= 255)
            put(folder, f"trix-{s}", np.stack([big, n[big]]))
            put(folder, f"pair-{s}", pair)
            put(folder, f"pairn-{s}", _narrow(more))
            ctx = (pair >> np.uint64(32)).astype(np.int64) - (bounds[s] >> 32)
            span = int((bounds[s + 1] - 1 >> 32 if s + 1 < shards else size) - (bounds[s] >> 32)) + 1
            put(folder, f"ctx-{s}", np.stack([np.bincount(ctx, x, span) for x in (
                more, more == 1, more == 2, more > 2)]).astype(np.int64))
            w, left = np.unique(pair & np.uint64(0xFFFFFFFF), return_counts=True)
            seen = np.concatenate([np.bincount(np.minimum(x, 5), minlength=6)[1:5] for x in (more, n)])
            for i in range(0, len(w), 1 << 16):
                m = len(w[i:i + (1 << 16)])
                cols = empty(m)
                cols |= {"s": pa.array(np.full(m, s)), "w": pa.array(w[i:i + m].astype(np.int64)),
                         "left": pa.array(left[i:i + m].astype(np.int64))}
                cols |= {c: pa.array(np.full(m, x if i == 0 else 0) * (np.arange(m) == 0)) for c, x in zip(_OF, seen)}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names)
            # contexts: the word before the pair and the pair's first word
            ab = a.astype(np.uint64) << np.uint64(32) | key >> np.uint64(32)
            order = np.argsort(ab, kind="stable")
            ab, n = ab[order], n[order]
            at = _groups(ab)
            stats = np.stack([np.add.reduceat(x, at) for x in (n, (n == 1) * 1, (n == 2) * 1, (n > 2) * 1)])
            ab = ab[at]
            cut = np.append(np.searchsorted(ab, bounds.astype(np.uint64)), len(ab))
            for t in np.flatnonzero(np.diff(cut)):
                part = slice(cut[t], cut[t + 1])
                cols = empty(1)
                cols |= {"shard": pa.array([t], pa.int64()), "size": pa.array([cut[t + 1] - cut[t]], pa.int64()),
                         "keys": pa.array([_packed(np.diff(ab[part], prepend=np.uint64(0)))], pa.binary()),
                         "stats": pa.array([_packed(stats[:, part].astype(np.int64))], pa.binary())}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names)

    return blobs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, WRITTEN)


def _write_contexts(rows: DataFrame, folder: str, shards: int, d3: list[float]) -> list[int]:
    """Writes the contexts of two words; the shards that have any."""
    def run(batches):
        for tab in _grouped(batches, "shard"):
            s, sizes = tab.column("shard")[0].as_py(), tab.column("size").to_pylist()
            key = np.concatenate([np.cumsum(_unpacked(x, m, np.uint64), dtype=np.uint64)
                                  for x, m in zip(tab.column("keys").to_pylist(), sizes)])
            stats = np.concatenate([_unpacked(x, 4 * m, np.int64).reshape(4, m)
                                    for x, m in zip(tab.column("stats").to_pylist(), sizes)], axis=1)
            order = np.argsort(key, kind="stable")  # parts of a context that was cut are added up
            key, stats = key[order], stats[:, order]
            at = _groups(key)
            total, one, two, more = np.add.reduceat(stats, at, axis=1)
            put(folder, f"c3-{s}", key[at])
            put(folder, f"c3t-{s}", _narrow(total))
            put(folder, f"c3w-{s}", (d3[0] * one + d3[1] * two + d3[2] * more) / total)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64())], ["s"])

    found = rows.where("shard is not null").select("shard", "keys", "stats", "size")
    return sorted(r[0] for r in found.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(
        run, "s long").collect())


def train(df: DataFrame, text: str = "text", order: int = 2) -> dict:
    """Model of order 2 or 3 of all rows of ``df``: its folder, sizes and discounts.

    Null and empty texts are one end token.  An empty table gives a model that
    knows no word.
    """
    if order not in (2, 3):
        raise ValueError("order 2 or 3")
    spark = df.sparkSession
    folder = scratch_path(spark, "lm")
    df = df.select(F.col(text))
    words = stored(_count_words(df), "lm-words")
    size, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    model = {"folder": folder, "V": size, "N": int(total), "bits": 0, "sizes": [0], "d2": [0.5, 1, 1.5],
             "d1": [0.5, 1, 1.5], "step": 1, "bounds": [0], "full": [], "left_total": 0, "left_n": [0, 0, 0],
             "order": order, "d3": [0.5, 1, 1.5], "full3": []}
    if not size:
        return model
    if size >= 1 << 32:
        raise ValueError("more than 2 ** 32 different words: a pair key holds two ids of 32 bits")
    bits = max(0, int(np.ceil(np.log2(size / VOCAB_SHARD)))) if size > VOCAB_SHARD else 0

    def write_words(batches):
        for tab in _grouped(batches, "shard"):
            s = tab.column("shard")[0].as_py()
            h, n = tab.column("h").to_numpy().view(np.uint64), tab.column("n").to_numpy()
            order = np.argsort(h)
            put(folder, f"vocab-{s}", h[order])
            put(folder, f"vocabn-{s}", n[order])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([len(h)], pa.int64())], ["s", "n"])

    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    rows = words.select(shard.alias("shard"), "h", "n").repartition(1 << bits, "shard").sortWithinPartitions("shard") \
        .mapInArrow(write_words, "s long, n long").collect()
    sizes = np.zeros(1 << bits, np.int64)
    for r in rows:
        sizes[r["s"]] = r["n"]
    vocab_args, limit = (folder, bits, sizes.tolist()), PAIR_SHARD

    def cut_shards(batches):
        offset = Vocabulary(*vocab_args).offset
        for b in batches:
            for s in b.column(0).to_pylist():
                h, n = get(folder, f"vocab-{s}"), np.array(get(folder, f"vocabn-{s}"))
                n[h == END] = 0  # no context; the begin mark comes as often
                yield pa.RecordBatch.from_arrays([pa.array(_cuts(int(offset[s]), n, size, limit))], ["cut"])

    full = spark.createDataFrame([(int(s),) for s in np.flatnonzero(sizes)], "s long")
    cuts = [r[0] for r in full.mapInArrow(cut_shards, "cut long").collect()]
    begins = words.where(F.col("h") == int(END.view(np.int64))).first()["n"]
    # the id after the last word is the begin mark
    bounds = np.unique(np.concatenate([[0], cuts, _cuts(size, np.array([begins]), size, limit)])).astype(np.int64)
    shards = len(bounds)
    step = max(1, -(-(size + 1) // max(1, -(-int(total) // limit))))
    model |= {"bits": bits, "sizes": sizes.tolist(), "step": step, "bounds": bounds.tolist()}

    def pairs(batches):
        vocab = Vocabulary(*vocab_args)
        held, n_held = [], 0

        def flush():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.append(np.searchsorted(key, bounds.astype(np.uint64)), len(key))
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int64)),
                 pa.array([bytes(pa.compress(np.diff(key[cut[s]:cut[s + 1]], prepend=np.uint64(0)).tobytes(), "zstd",
                                             asbytes=True)) for s in full], pa.binary()),
                 pa.array([bytes(pa.compress(n[cut[s]:cut[s + 1]].astype(np.uint32).tobytes(), "zstd", asbytes=True))
                           for s in full], pa.binary()),
                 pa.array(np.diff(cut)[full].astype(np.int64))], ["shard", "keys", "counts", "size"])

        for b in batches:
            for w in T.word_pieces(b.column(0)):
                h, row = tokens(w)
                known, inverse = np.unique(h, return_inverse=True)
                ids = vocab.ids(known)[inverse].astype(np.uint64)
                before = np.empty_like(ids)
                before[1:] = ids[:-1]
                before[np.concatenate([[True], row[1:] != row[:-1]])] = size
                held.append(before << np.uint64(32) | ids)
                n_held += len(ids)
                if n_held >= BUFFER:
                    yield from flush()
                    held, n_held = [], 0
        if held:
            yield from flush()

    def write_pairs(batches):
        for tab in _grouped(batches, "shard"):
            s = tab.column("shard")[0].as_py()
            keys, counts = [], []
            for k, c, m in zip(tab.column("keys").to_pylist(), tab.column("counts").to_pylist(),
                               tab.column("size").to_pylist()):
                keys.append(np.cumsum(np.frombuffer(pa.decompress(k, m * 8, "zstd"), np.uint64), dtype=np.uint64))
                counts.append(np.frombuffer(pa.decompress(c, m * 4, "zstd"), np.uint32))
            key, counts = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order].astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, n = key[at], np.add.reduceat(counts, at)
            ctx = (key >> np.uint64(32)).astype(np.int64) - (bounds[s] >> 32)
            span = int((bounds[s + 1] - 1 >> 32 if s + 1 < shards else size) - (bounds[s] >> 32)) + 1
            put(folder, f"pair-{s}", key)
            put(folder, f"pairn-{s}", n.astype(np.uint32 if n.max() < 1 << 32 else np.uint64))
            put(folder, f"ctx-{s}", np.stack([np.bincount(ctx, x, span) for x in (
                n, n == 1, n == 2, n > 2)]).astype(np.int64))
            w, left = np.unique(key & np.uint64(0xFFFFFFFF), return_counts=True)
            of = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
            for i in range(0, len(w), 1 << 16):
                part = slice(i, i + (1 << 16))
                m = len(w[part])
                seen = [pa.array(np.full(m, x if i == 0 else 0) * (np.arange(m) == 0)) for x in of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, s)), pa.array(w[part].astype(np.int64)), pa.array(left[part].astype(np.int64)),
                     *seen], ["s", "w", "left", "n1", "n2", "n3", "n4"])

    if order == 2:
        blobs = df.mapInArrow(pairs, "shard long, keys binary, counts binary, size long")
        lefts = stored(blobs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(
            write_pairs, "s long, w long, left long, n1 long, n2 long, n3 long, n4 long"), "lm-left")
    else:
        written = stored(_write_triples(_triple_blobs(df, vocab_args, size, bounds), folder, bounds, size), "lm-triples")
        lefts = written.where("s is not null")
        model["d3"] = _discounts(lefts.agg(*(F.sum(f"m{i}") for i in range(1, 5))).first())
        model["full3"] = _write_contexts(written, folder, shards, model["d3"])
    model["full"] = sorted(r[0] for r in lefts.select("s").distinct().collect())  # a part may have no follower
    model["d2"] = _discounts(lefts.agg(*(F.sum(f"n{i}") for i in range(1, 5))).first())
    left = stored(lefts.groupBy("w").agg(F.sum("left").alias("left")), "lm-left-sum")
    r = left.agg(F.sum("left"), *(F.sum((F.col("left") == k).cast("long")) for k in (1, 2, 3, 4)), F.count("*")).first()
    model |= {"left_total": r[0], "d1": _discounts(r[1:5]), "left_n": [r[1], r[2], r[5] - r[1] - r[2]]}

    def write_left(batches):
        for tab in _grouped(batches, "shard"):
            s = tab.column("shard")[0].as_py()
            a = np.zeros(step, np.int64)
            a[tab.column("w").to_numpy() - s * step] = tab.column("left").to_numpy()
            put(folder, f"left-{s}", a)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64())], ["s"])

    left.select((F.col("w") / step).cast("long").alias("shard"), "w", "left").repartition(shards, "shard") \
        .sortWithinPartitions("shard").mapInArrow(write_left, "s long").collect()
    return model


class Scorer:
    """Reads one model in a task."""

    def __init__(self, model: dict):
        self.m, f = model, model["folder"]
        self.vocab = Vocabulary(f, model["bits"], model["sizes"])
        self.files = lru_cache(maxsize=None)(lambda name: get(f, name))
        self.bounds, self.full, self.full3 = np.array(model["bounds"], np.int64), set(model["full"]), set(model["full3"])
        self.spread = lru_cache(maxsize=None)(self._spread)
        gone = model["d1"][0] * model["left_n"][0] + model["d1"][1] * model["left_n"][1] \
            + model["d1"][2] * model["left_n"][2]
        self.rest = (gone / model["left_total"] if model["left_total"] else 1.0) / (model["V"] + 1)

    @staticmethod
    def discount(n, d):
        return np.where(n == 0, 0, np.where(n == 1, d[0], np.where(n == 2, d[1], d[2])))

    def _by_shard(self, sorted_ids, shard_of, fill, read):
        """``read(shard, part)`` for the runs of sorted ids of one shard."""
        out = [np.full(len(sorted_ids), x, np.float64) for x in fill]
        shard = shard_of(sorted_ids)
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            if shard[a] >= 0:
                for o, v in zip(out, read(int(shard[a]), sorted_ids[a:b])):
                    o[a:b] = v
        return out

    def words(self, h: np.ndarray):
        """Per sorted distinct hash: id, training count, lower-order probability."""
        m, ids = self.m, self.vocab.ids(h)
        off = self.vocab.offset
        known = ids >= 0
        k = ids[known]

        def count(s, part):
            return [self.files(f"vocabn-{s}")[part - off[s]]]

        c, = self._by_shard(k, lambda x: np.searchsorted(off, x, side="right") - 1, [0], count)
        left, = self._by_shard(k, lambda x: x // m["step"], [0],
                               lambda s, part: [self.files(f"left-{s}")[part - s * m["step"]]])
        counts, p = np.zeros(len(h)), np.full(len(h), self.rest)
        counts[known] = c
        if m["left_total"]:
            p[known] += (left - self.discount(left, m["d1"])) / m["left_total"]
        return ids, counts, p

    def _shard_of(self, key: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, key, side="right") - 1

    def _followers(self, s: int, ids) -> np.ndarray:
        """Total and numbers of followers of contexts as far as shard ``s`` goes."""
        if s not in self.full:
            return np.zeros((4, *np.shape(ids)))
        return self.files(f"ctx-{s}")[:, ids - (self.bounds[s] >> 32)].astype(np.float64)

    def _spread(self, v: int) -> np.ndarray:
        a, z = self._shard_of(np.array([v << 32, (v + 1 << 32) - 1]))
        return sum(self._followers(s, v) for s in range(a, z + 1))

    def contexts(self, ids: np.ndarray):
        """Per sorted distinct context id: total and backoff weight."""
        d = self.m["d2"]
        first, last = self._shard_of(ids << 32), self._shard_of((ids + 1 << 32) - 1)
        rows = self._by_shard(ids, lambda x: np.where((x >= 0) & (first == last), first, -1), [0] * 4, self._followers)
        for i in np.flatnonzero((ids >= 0) & (first < last)):
            for o, x in zip(rows, self.spread(int(ids[i]))):
                o[i] = x
        t, a, b, c = rows
        return t, np.where(t > 0, (d[0] * a + d[1] * b + d[2] * c) / np.maximum(t, 1), 1.0)

    def pairs(self, key: np.ndarray):
        """Counts of sorted distinct pair keys."""
        def read(s, part):
            if s not in self.full:
                return [0]
            keys, n = self.files(f"pair-{s}"), self.files(f"pairn-{s}")
            at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
            return [np.where(keys[at] == part, n[at], 0)]

        return self._by_shard(key, lambda x: self._shard_of(x.astype(np.int64)), [0], read)[0]

    def long_contexts(self, key: np.ndarray):
        """Totals and backoff weights of sorted distinct contexts of two ids."""
        def read(s, part):
            if s not in self.full3:
                return [0, 1]
            keys = self.files(f"c3-{s}")
            at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
            hit = keys[at] == part
            return [np.where(hit, self.files(f"c3t-{s}")[at], 0), np.where(hit, self.files(f"c3w-{s}")[at], 1)]

        return self._by_shard(key, lambda x: self._shard_of(x.astype(np.int64)), [0, 1], read)

    def triples(self, key: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Counts of pairs (sorted) after the words ``a``."""
        out = np.zeros(len(key))
        shard = self._shard_of(key.astype(np.int64))
        for i, z in zip(*(lambda c: (c[:-1], c[1:]))(np.append(_groups(shard), len(shard)))):
            s = int(shard[i])
            if s not in self.full:
                continue
            pairs, tri = self.files(f"pair-{s}"), self.files(f"tri-{s}")
            at = np.minimum(np.searchsorted(pairs, key[i:z]), len(pairs) - 1)
            want = at.astype(np.uint64) << np.uint64(32) | a[i:z].astype(np.uint64)
            place = np.minimum(np.searchsorted(tri, want), len(tri) - 1)
            n = np.where((pairs[at] == key[i:z]) & (tri[place] == want), self.files(f"trin-{s}")[place], 0).astype(np.float64)
            big = np.flatnonzero(n == 255)
            if len(big):
                where, value = self.files(f"trix-{s}")
                n[big] = value[np.searchsorted(where, place[big])]
            out[i:z] = n
        return out

    def score(self, w: T.Words):
        m = self.m
        h, row = tokens(w)
        uniq, inverse = np.unique(h, return_inverse=True)
        ids, counts, p1 = self.words(uniq)
        ids, counts, p1 = ids[inverse], counts[inverse], p1[inverse]
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[np.concatenate([[True], row[1:] != row[:-1]])] = m["V"] if m["V"] else -1
        ctx, at = np.unique(before, return_inverse=True)
        total, weight = (x[at] for x in self.contexts(ctx))
        p = weight * p1
        both = (before >= 0) & (ids >= 0)
        key, at = np.unique(before[both].astype(np.uint64) << np.uint64(32) | ids[both].astype(np.uint64),
                            return_inverse=True)
        if len(key):
            n = self.pairs(key)[at]
            p[both] += (n - self.discount(n, m["d2"])) / np.maximum(total[both], 1)
        if m["order"] == 3 and m["V"]:
            one, two = _befores(ids, row, m["V"])
            seen = (one >= 0) & (two >= 0)
            key, at = np.unique(two[seen].astype(np.uint64) << np.uint64(32) | one[seen].astype(np.uint64), return_inverse=True)
            total, weight = (x[at] for x in self.long_contexts(key)) if len(key) else (np.zeros(0), np.zeros(0))
            p[seen] *= weight
            mine = np.flatnonzero(seen)[(total > 0) & (ids[seen] >= 0)]
            if len(mine):
                total = total[(total > 0) & (ids[seen] >= 0)]
                bc = one[mine].astype(np.uint64) << np.uint64(32) | ids[mine].astype(np.uint64)
                order = np.lexsort((two[mine], bc))
                n = np.empty(len(mine))
                n[order] = self.triples(bc[order], two[mine][order])
                p[mine] += (n - self.discount(n, m["d3"])) / total
        base = np.log10((counts + 0.1) / (m["N"] + 0.1 * (m["V"] + 1)))
        return (w.per_doc() + 1, np.bincount(row, counts > 0, w.rows), np.bincount(row, base, w.rows),
                np.bincount(row, np.log10(p), w.rows))


@lru_cache(maxsize=1)
def _scorer(key: str) -> Scorer:
    import json

    return Scorer(json.loads(key))


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: ``id_col``, ``n_tokens``, ``n_known``, ``base_score``
    (smoothed unigram) and ``score``, log10 probabilities of the whole text,
    and ``perplexity`` per token.  Null and empty texts are one end token."""
    import json

    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    df = df.select(id_col, text)
    schema = StructType([df.schema[id_col], *(StructField(c, t, False) for c, t in (
        ("n_tokens", LongType()), ("n_known", LongType()), ("base_score", DoubleType()), ("score", DoubleType()),
        ("perplexity", DoubleType())))])
    key = json.dumps(model)

    def run(batches):
        s = _scorer(key)
        for b in batches:
            for w in T.word_pieces(b.column(1)):
                n, known, base, lp = s.score(w)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(w.row0, w.rows), pa.array(n.astype(np.int64)),
                     pa.array(known.astype(np.int64)), pa.array(base), pa.array(lp),
                     pa.array(np.power(10.0, np.minimum(-lp / n, 300)))], schema.names)

    return df.mapInArrow(run, schema)


def score_documents(docs: DataFrame, order: int = 2) -> DataFrame:
    """Scores of the whole table under a model of its training rows."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    model = train(docs.where(~held), order=order)
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model["N"]).cast("long").alias("train_tokens"),
        "base_score", "score", "perplexity")
