"""Repeated-passage removal with a sparse suffix array.

A passage is a run of ``min_words`` words (A-Z lower-cased).  Of all suffixes
only those at minimiser positions are kept: the start with the smallest hash
of ``SEED`` words among ``STEP`` neighbouring starts.  Every passage window
has exactly one such suffix at most ``STEP - 1`` words after its start, so
equal passages keep equal suffixes, at about 2 of ``STEP + 1`` positions.

The kept suffixes are sorted over the cluster by their first
``min_words - STEP + 1`` words and neighbours are compared; suffixes without
an equal neighbour are done.  Equal ones are extended left and right: where
the whole stretch of windows that a suffix stands for is the same in all its
occurrences it is settled at once, else each of its windows is compared.  The
result is exact: a window counts as repeated if and only if the same words
occur at another place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import textkit as T
from flowsentry.llm.jaccard import stored

MIN_WORDS, STEP, SEED = 50, 16, 8
#: word stretches up to which the list of cuts is broadcast (16 bytes each)
BROADCAST_ROWS = 2_000_000
#: rows of a group above which its rows are met by broadcast, and most groups met so
HEAVY, MOST_HEAVY = 20_000, 100_000


_BASE = 0x9E3779B97F4A7C15
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the base, or of its inverse modulo 2 ** 64."""
    if len(_POWERS[kind]) < n:
        p = np.full(max(n, T.CHUNK_BYTES // 4), _BASE if kind == "up" else pow(_BASE, -1, 1 << 64), np.uint64)
        p[0] = 1
        _POWERS[kind] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[kind][:n]


class Spans:
    """Hashes of word runs of one piece of text."""

    def __init__(self, w: T.Words):
        self.h = w.hashes()
        n = len(self.h)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(self.h * _power("up", n), out=self.sum[1:], dtype=np.uint64)
        self.down = _power("down", n + 1)

    def hash(self, start, end):
        run = (self.sum[end] - self.sum[start]) * self.down[start]
        return T.mix(run + (end - start).astype(np.uint64))


def kept_suffixes(w: T.Words, g: np.ndarray, min_words: int):
    """(row, suffix start, first and last window start it stands for)."""
    n, per_doc = len(g), w.per_doc()
    at = np.arange(n)
    val, size = g.copy(), 1
    while size < STEP:  # sliding leftmost minimum by doubling
        left, right = val[:-size] if size < len(val) else val[:0], val[size:]
        take = left <= right
        at = np.where(take, at[:len(left)], at[size:])
        val = np.where(take, left, right)
        size *= 2
    first = np.cumsum(per_doc) - per_doc
    windows = np.maximum(per_doc - min_words + 1, 0)
    row = np.repeat(np.arange(w.rows), windows)
    p = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + first[row]
    m = at[p] if len(p) else p
    new = np.ones(len(p), bool)
    new[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(p))[:len(lo)] - 1
    return row[lo], m[lo], p[lo], p[hi], first


def _stretch(lo: str, hi: str) -> Column:
    """A stretch as one number, the lowest bit free: a set of numbers takes a
    fraction of the room of a set of structs."""
    return F.shiftleft(F.col(lo).cast("long"), 32).bitwiseOR(F.shiftleft(F.col(hi).cast("long"), 1))


def _stretches(col: pa.Array):
    """Of a column of lists of stretches: (row, start, end, lowest bit) of each."""
    n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(n)), n), x >> 32, (x & 0xFFFFFFFF) >> 1, (x & 1).astype(bool)


def _kind(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def _suffix_table(df: DataFrame, min_words: int) -> DataFrame:
    head = min_words - STEP + 1

    def run(batches):
        T.take_over("suffixes")
        for b in batches:
            for w in T.word_pieces(b.column(1)):
                if len(w) < min_words:
                    continue
                s = Spans(w)
                row, m, lo, hi, first = kept_suffixes(w, T.gram_hashes(s.h, SEED), min_words)
                base = first[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(T.signed(s.hash(m, m + head))), pa.array(T.signed(s.hash(lo, hi + min_words))),
                     b.column(0).slice(w.row0, w.rows).take(pa.array(row)),
                     *(pa.array((x - base).astype(np.int32)) for x in (m, lo, hi))],
                    ["key", "whole", "id", "m", "lo", "hi"])

    return df.mapInArrow(T.trimmed(run), f"key long, whole long, id {_kind(df)}, m int, lo int, hi int")


def _equal_neighbours(suffixes: DataFrame) -> DataFrame:
    """Rows of the sorted suffixes that have an equal neighbour.  The first and
    last row of a partition stay too (their neighbour is elsewhere)."""
    def run(batches):
        last = None  # the row before, not yet decided
        kept = False
        for b in batches:
            if not b.num_rows:
                continue
            if last is not None:
                b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            key = b.column("key").to_numpy()
            same = key[1:] == key[:-1]
            keep = np.zeros(len(key), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= kept or last is None
            kept, last = bool(keep[-1]), b.slice(len(key) - 1)
            keep[-1] = False
            yield b.filter(pa.array(keep))
        if last is not None:
            yield last

    return suffixes.repartitionByRange("key", "id", "m").sortWithinPartitions("key", "id", "m") \
        .mapInArrow(T.trimmed(run), suffixes.schema)


def _joined(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of their group (one row per key, ``c`` its size).
    Groups of more than ``HEAVY`` rows, and of so many that there are at most
    ``MOST_HEAVY`` of them, are broadcast, so a group that holds a third of all
    rows is met where its rows are; the others meet in a shuffle."""
    groups = stored(groups, "suffix-counts")
    limit = max(HEAVY, (groups.agg(F.sum("c")).first()[0] or 0) // MOST_HEAVY)
    met = rows.join(F.broadcast(groups.where(F.col("c") > limit).withColumn("hot", F.lit(True))), key, "left")
    rest = met.where("hot is null").select(*rows.columns).join(groups.where(F.col("c") <= limit), key)
    return met.where("hot").drop("hot").unionByName(rest)


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text: str = "text",
                     min_words: int = MIN_WORDS, key: Column | None = None) -> DataFrame:
    """Word stretches ``(id, lo, hi, copy, own_lo, own_hi)``, end exclusive,
    made of repeated windows.

    ``copy``: the stretch is not the first occurrence (by id, then position).
    ``own_lo/own_hi``: the first occurrence where that is in the same text,
    else null.  Stretches of one text may overlap.  ``key`` (any type with an
    order) stands in for the id.
    """
    if min_words < STEP + SEED:
        raise ValueError(f"min_words must be {STEP + SEED} or more")
    key = F.col(id_col).cast("long") if key is None else key
    docs = df.select(key.alias("id"), F.col(text).alias("t")).where("id is not null")
    cand = stored(_equal_neighbours(stored(_suffix_table(docs, min_words), "suffixes")), "suffix-equal")
    groups = cand.groupBy("key").agg(
        F.count("*").alias("c"), F.min("whole").alias("w0"), F.max("whole").alias("w1"),
        F.min(F.struct("id", "lo", "hi")).alias("o")).where("c > 1")
    cand = _joined(cand, groups, "key").select("id", "lo", "hi", "o", (F.col("w0") == F.col("w1")).alias("alike"))
    cand = stored(cand, "suffix-groups")

    def out(d, lo, hi, first_id, first_lo, first_hi):
        copy = (F.col("id") != first_id) | (lo != first_lo)
        own = copy & (F.col("id") == first_id)
        return d.select("id", lo.alias("lo"), hi.alias("hi"), copy.alias("copy"),
                        F.when(own, first_lo).alias("own_lo"), F.when(own, first_hi).alias("own_hi"))

    settled = out(cand.where("alike"), F.col("lo"), F.col("hi") + min_words, F.col("o.id"), F.col("o.lo"),
                  F.col("o.hi") + min_words)

    # the others: every window of the suffix, from the texts that hold one
    todo = cand.where("not alike").groupBy("id").agg(F.collect_set(_stretch("lo", "hi")).alias("r"))
    texts = docs.join(todo, "id").select("id", "t", "r")

    def windows(batches):
        T.take_over("suffixes")
        for b in batches:
            owner, lo, hi, _ = _stretches(b.column(2))
            for w in T.word_pieces(b.column(1)):
                mine = (owner >= w.row0) & (owner < w.row0 + w.rows)
                a, z, row = lo[mine], hi[mine], owner[mine] - w.row0
                n = z - a + 1
                p = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                row = np.repeat(row, n)
                per_doc = w.per_doc()
                start = p + (np.cumsum(per_doc) - per_doc)[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(T.signed(Spans(w).hash(start, start + min_words))),
                     b.column(0).take(pa.array(row + w.row0)), pa.array(p.astype(np.int32))], ["win", "id", "p"])

    found = stored(texts.mapInArrow(T.trimmed(windows), f"win long, id {_kind(docs)}, p int"), "suffix-windows")
    firsts = found.groupBy("win").agg(F.count("*").alias("c"), F.min(F.struct("id", "p")).alias("o")).where("c > 1")
    fine = out(_joined(found, firsts, "win"), F.col("p"), F.col("p") + min_words, F.col("o.id"), F.col("o.p"),
               F.col("o.p") + min_words)
    return settled.unionByName(fine)


def _union(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Disjoint sorted stretches covering the given ones."""
    if not len(lo):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > top[:-1]
    at = np.flatnonzero(new)
    return np.stack([lo[at], np.append(top[at[1:] - 1], top[-1])], 1)


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both disjoint and sorted."""
    out, b, j = [], b.tolist(), 0
    for lo, hi in a.tolist():
        while j < len(b) and b[j][1] <= lo:
            j += 1
        k = j
        while k < len(b) and b[k][0] < hi:
            if b[k][0] > lo:
                out.append((lo, b[k][0]))
            lo = max(lo, b[k][1])
            k += 1
        if lo < hi:
            out.append((lo, hi))
    return np.array(out, np.int64).reshape(-1, 2)


def _removed(wins: pa.Array, own: pa.Array) -> list[pa.Array]:
    """``n_repeated, n_removed, removed`` of rows with these stretches (lowest
    bit: a copy) and first occurrences in the same text.  The rows are laid end
    to end, one place apart, so one pass serves all."""
    row, lo, hi, copy = _stretches(wins)
    own_row, own_lo, own_hi, _ = _stretches(own)
    size = np.zeros(len(wins), np.int64)
    np.maximum.at(size, row, hi)
    np.maximum.at(size, own_row, own_hi)
    base = np.cumsum(size + 1) - size - 1
    lo, hi = lo + base[row], hi + base[row]
    every = _union(lo, hi)
    cut = _minus(_union(lo[copy], hi[copy]), _union(own_lo + base[own_row], own_hi + base[own_row]))

    def of(x):
        return np.searchsorted(base, x[:, 0], side="right") - 1

    def words(x):
        return pa.array(np.bincount(of(x), x[:, 1] - x[:, 0], len(wins)).astype(np.int64))
    at = of(cut)
    offs = np.append(0, np.cumsum(np.bincount(at, minlength=len(wins)))).astype(np.int32)
    places = pa.StructArray.from_arrays([pa.array(cut[:, i] - base[at]) for i in (0, 1)], ["lo", "hi"])
    return [words(every), words(cut), pa.ListArray.from_arrays(pa.array(offs), places)]


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text",
                   min_words: int = MIN_WORDS, key: Column | None = None) -> DataFrame:
    """One row per text with a repeated passage: ``id_col``, ``n_repeated``
    words inside repeated windows, ``n_removed`` words inside windows that are
    not the first occurrence, and ``removed`` (disjoint word stretches, end
    exclusive).  A passage that repeats inside one text keeps its first place.

    Null and empty texts, texts shorter than ``min_words`` words and rows with
    a null id have no row.  Repeated rows (one id, one text) count as
    repeated, but nothing is removed from them.  ``key`` stands in for the id.
    """
    wins = repeated_windows(df, id_col, text, min_words, key)
    lists = wins.select("id", _stretch("lo", "hi").bitwiseOR(F.col("copy").cast("long")).alias("wins"),
                        _stretch("own_lo", "own_hi").alias("own")).distinct().groupBy("id").agg(
        F.collect_set("wins").alias("wins"), F.collect_set("own").alias("own"))

    def run(batches):
        T.take_over("suffixes")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_removed(b.column(1), b.column(2))],
                                             [id_col, "n_repeated", "n_removed", "removed"])

    return lists.mapInArrow(T.trimmed(run), f"`{id_col}` {_kind(lists)}, n_repeated long, n_removed long, "
                                 "removed array<struct<lo:long,hi:long>>")


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text",
                 min_words: int = MIN_WORDS, null_ids: bool = False) -> DataFrame:
    """``df`` with the repeated stretches cut out of ``text`` (a cut takes the
    words and the white space after them).  Rows whose words are all cut go;
    every other row stays, unchanged where nothing repeats.

    A row is known by its id and its text, so texts that share an id are
    compared with each other too.  With ``null_ids`` rows with a null id take
    part, after all others; else they stay as they are."""
    parts = {"_none": F.col(id_col).isNull(), "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")),
             "_text": F.xxhash64(text)}
    row = F.struct(*(c.alias(n) for n, c in parts.items()))
    if not null_ids:
        row = F.when(F.col(id_col).isNotNull(), row)
    spans = stored(repeated_spans(df, id_col, text, min_words, row).where("n_removed > 0")
                   .select(*(F.col(id_col)[n].alias(n) for n in parts), F.col("removed").alias("_cut")), "suffix-cuts")
    small = spans.agg(F.sum(F.size("_cut"))).first()[0] or 0
    same = [c == F.col(n) for n, c in parts.items()]
    with_cuts = df.join(F.broadcast(spans) if small <= BROADCAST_ROWS else spans, same, "left").drop(*parts)
    at, names, schema = df.columns.index(text), df.columns, df.schema

    def run(batches):
        for b in batches:
            cuts = b.column(len(names)).to_pylist()
            touched = [i for i, c in enumerate(cuts) if c]
            col = b.column(at)
            new, gone = {}, set()
            if touched:
                part = col.take(pa.array(touched))
                k = 0
                for w in T.word_pieces(part):
                    raw = T.string_buffers(part.slice(w.row0, w.rows))
                    base = raw[1][0]
                    first = np.cumsum(w.per_doc()) - w.per_doc()
                    for r in range(w.rows):
                        i = touched[w.row0 + r]
                        lo, hi, n = w.offs[r], w.offs[r + 1], int(w.per_doc()[r])
                        edge = np.append(w.start[first[r]:first[r] + n], hi)
                        out, pos = [], lo
                        for c in cuts[i]:
                            out.append(bytes(raw[0][base + pos:base + edge[c["lo"]]]))
                            pos = edge[min(c["hi"], n)]
                        out.append(bytes(raw[0][base + pos:base + hi]))
                        new[i] = b"".join(out).decode("utf-8", "replace")
                        if sum(c["hi"] - c["lo"] for c in cuts[i]) >= n:
                            gone.add(i)
                        k += 1
                texts = col.to_pylist()
                for i, t in new.items():
                    texts[i] = t
                col = pa.array(texts, pa.string())
            cols = [col if j == at else b.column(j) for j in range(len(names))]
            out = pa.RecordBatch.from_arrays(cols, names)
            yield out.filter(pa.array([i not in gone for i in range(b.num_rows)])) if gone else out

    return with_cuts.mapInArrow(T.trimmed(run), schema)


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w
  FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - {MIN_WORDS} + 2)) AS s, w FROM d WHERE len(w) >= {MIN_WORDS}),
win AS (SELECT doc_id, s, md5(array_to_string(w[s : s + {MIN_WORDS} - 1], ' ')) AS h FROM p),
o AS (SELECT h, count(*) AS c, min((doc_id, s)) AS first FROM win GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, s, first[1] AS fd, first[2] AS fs FROM win JOIN o USING (h)),
cover AS (
  SELECT doc_id, x, bool_or(kind = 'copy') AND NOT bool_or(kind = 'own') AS gone FROM (
    SELECT DISTINCT doc_id, kind, unnest(range(s, s + {MIN_WORDS})) AS x FROM (
      SELECT doc_id, s, CASE WHEN doc_id = fd AND s = fs THEN 'first' ELSE 'copy' END AS kind FROM r
      UNION ALL SELECT DISTINCT doc_id, fs, 'own' FROM r WHERE doc_id = fd AND s <> fs) k) e
  GROUP BY doc_id, x)
SELECT doc_id, count(*) AS n_repeated, count(*) FILTER (WHERE gone) AS n_removed FROM cover GROUP BY doc_id"""
