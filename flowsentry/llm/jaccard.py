"""N-gram Jaccard join with grouped prefixes.

Texts become sets of distinct word-shingle hashes.  Equal sets are one class;
classes with the same prefix and size are one group, and only groups post
their prefix tokens.  Group pairs that share a token are filtered by size and
by an upper bound of the overlap, expanded to their classes, and verified on
the whole sets.

The result is the components of the link graph, so pairs inside a known
component are never formed: first every class is tried against one pivot of
its group and every group against one pivot of each token (linear), then only
pairs of different components meet, in blocks of bounded size.  Every pair of
classes that share a prefix token is thus either verified, excluded by a
bound, or already connected; no link is lost.

The global token order puts shingles that many documents share last (by
count), all others by hash.  It only steers cost: any order gives the same
result, so the list of frequent shingles may be bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import textkit as T
from flowsentry.llm.components import components
from flowsentry.session import scratch_path

#: least and usual most number of hash buckets (a byte each) of the overlap
#: bound of a class, about half the set size; very large sets get 1 in 64
BUCKETS_LEAST, BUCKETS_MOST = 64, 512
#: shingles that the token order puts last (the most frequent ones, 8 bytes
#: each), the least count of one, and the shingles a task gathers to count
FREQUENT, FREQUENT_LEAST, BUFFER = 1 << 20, 3, 1 << 21
#: rows on the two sides of a block
LEFT, RIGHT = 256, 4096
#: rows of a bucket up to which its possible pairs are written out
SMALL = 64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ids up to which a candidate list is broadcast (8 bytes each)
BROADCAST_IDS = 2_000_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back; the shuffle
    files of the jobs that made it go at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)


def shingle_sets(w: T.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as (row, hash), sorted by both.  A row with 1 to k-1
    words has its whole sequence as its only shingle; one without has none."""
    h, per_doc = w.hashes(), w.per_doc()
    s = T.gram_hashes(h, k)
    same = w.doc[:len(s)] == w.doc[k - 1:] if len(s) else np.zeros(0, bool)
    rows, vals = [w.doc[:len(s)][same]], [s[same]]
    first = np.cumsum(per_doc) - per_doc
    for c in range(1, k):
        short = np.flatnonzero(per_doc == c)
        if len(short):
            rows.append(short)
            vals.append(T.gram_hashes(h, c)[first[short]])
    row, val = np.concatenate(rows), np.concatenate(vals)
    order = np.lexsort((val, row))
    row, val = row[order], val[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (val[1:] != val[:-1])
    return row[new], val[new]


def frequent_shingles(df: DataFrame, text: str, k: int) -> np.ndarray:
    """Hashes of the ``FREQUENT`` most frequent shingles, rarest first, counted
    where a task meets them twice among ``BUFFER``."""
    def count(batches):
        T.take_over("jaccard")
        held, size = [], 0

        def flush():
            s, n = np.unique(np.concatenate(held), return_counts=True)
            s, n = s[n > 1], n[n > 1]
            for i in range(0, len(s), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(s[i:i + (1 << 16)])),
                                                  pa.array(n[i:i + (1 << 16)].astype(np.int64))], ["s", "n"])

        for b in batches:
            for w in T.word_pieces(b.column(0)):
                held.append(shingle_sets(w, k)[1])
                size += len(held[-1])
                if size >= BUFFER:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    top = df.select(F.col(text)).mapInArrow(T.trimmed(count), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= FREQUENT_LEAST).orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").toPandas()
    return top.s.to_numpy(np.int64)[::-1].view(np.uint64)


def _prefix_length(n, percent: int):
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def signatures(df: DataFrame, id_col: str, text: str, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Per row: id, set size ``n``, 128-bit set hash, prefix tokens, group key
    and the bucket counts of the overlap bound."""
    order = np.argsort(frequent)
    shared = df.sparkSession.sparkContext.broadcast((frequent[order], order.astype(np.int32)))

    def run(batches):
        T.take_over("jaccard")
        known, order = shared.value
        for b in batches:
            for w in T.word_pieces(b.column(1)):
                row, s = shingle_sets(w, k)
                n = np.bincount(row, minlength=w.rows)
                rank = np.full(len(s), -1)
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[at] == s, order[at], -1)
                start = np.cumsum(n) - n
                m = T.mix(s)
                sums = np.zeros((2, w.rows), np.uint64)
                full = n > 0
                if full.any():
                    sums[0][full] = np.add.reduceat(m, start[full])
                    sums[1][full] = np.add.reduceat(T.mix(m ^ np.uint64(0x5851F42D4C957F2D)), start[full])
                wide = 1 << np.ceil(np.log2(np.clip(
                    n / 2, BUCKETS_LEAST, np.maximum(BUCKETS_MOST, n / 64)))).astype(np.int64)
                at = np.cumsum(wide) - wide
                counts = np.minimum(np.bincount(at[row] + (m >> np.uint64(32)).astype(np.int64) % wide[row],
                                                minlength=wide.sum()), 255).astype(np.uint8)
                sketch = [counts[i:i + j].tobytes() for i, j in zip(at, wide)]
                by = np.lexsort((s, rank, row))
                p = _prefix_length(n, percent)
                prefix = s[by][np.arange(len(s)) - start[row] < p[row]]
                at = np.cumsum(p) - p
                group = np.zeros(w.rows, np.uint64)
                if full.any():
                    place = np.arange(len(prefix)) - np.repeat(at, p)
                    group[full] = np.add.reduceat(T.mix(prefix * (2 * place.astype(np.uint64) + np.uint64(1))), at[full])
                group = T.mix(group + n.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(w.row0, w.rows).cast(pa.int64()), pa.array(n.astype(np.int64)),
                     pa.array(T.signed(sums[0])), pa.array(T.signed(sums[1])), pa.array(T.signed(group)),
                     T.long_lists(T.signed(prefix), p, pa.int64()),
                     pa.array(sketch, pa.binary())],
                    ["id", "n", "s1", "s2", "gid", "prefix", "counts"])

    return df.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(
        T.trimmed(run), "id long, n long, s1 long, s2 long, gid long, prefix array<long>, counts binary")


def bound_ok(n, sketches: list[bytes], u, v, percent: int) -> np.ndarray:
    """Can the sets of rows ``u`` and ``v`` reach the similarity, by sizes
    ``n`` and bucket counts?  255 stands for 255 or more, so two of them bound
    nothing; a longer sketch is folded to the length of the other."""
    wide = np.array([len(x) for x in sketches])
    place, rows = np.zeros(len(wide), np.int64), {}
    for b in np.unique(wide):
        at = np.flatnonzero(wide == b)
        place[at] = np.arange(len(at))
        rows[b] = np.frombuffer(b"".join(sketches[i] for i in at), np.uint8).reshape(-1, b)
    most = np.zeros(len(u), np.int64)
    for b in np.unique(wide[u]) if len(u) else ():
        for c in np.unique(wide[v]):
            k = np.flatnonzero((wide[u] == b) & (wide[v] == c))
            step = max(1, (1 << 22) // max(b, c))
            for i in range(0, len(k), step):
                j = k[i:i + step]
                x, y = (np.minimum(m.reshape(len(j), -1, min(b, c)).sum(axis=1, dtype=np.int64), 255)
                        for m in (rows[b][place[u[j]]], rows[c][place[v[j]]]))
                most[j] = np.where((x == 255) & (y == 255), 1 << 30, np.minimum(x, y)).sum(axis=1)
    na, nb = n[u], n[v]
    return (100 + percent) * np.minimum(most, np.minimum(na, nb)) >= percent * (na + nb)


def _bounded_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    side = classes.select("cid", "n", "counts")
    both = pairs.join(side.toDF("a", "na", "ca"), "a").join(side.toDF("b", "nb", "cb"), "b")

    def run(batches):
        for b in batches:
            m = b.num_rows
            n = np.concatenate([b.column("na").to_numpy(), b.column("nb").to_numpy()])
            ok = bound_ok(n, b.column("ca").to_pylist() + b.column("cb").to_pylist(), np.arange(m),
                          np.arange(m, 2 * m), percent)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(T.trimmed(run), "a long, b long")


def verified(pairs: DataFrame, df: DataFrame, id_col: str, text: str, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of ids whose whole sets reach the similarity.

    Sets are computed again from the texts of the candidates only.
    """
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "jaccard-ids")
    few = ids.count() <= BROADCAST_IDS
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    docs = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def run(batches):
        for b in batches:
            for w in T.word_pieces(b.column(1)):
                row, s = shingle_sets(w, k)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(w.row0, w.rows),
                     T.long_lists(T.signed(s), np.bincount(row, minlength=w.rows), pa.int64())], ["id", "v"])

    # an id that comes twice with different texts is one document with all its classes' links
    sets = docs.mapInArrow(T.trimmed(run), "id long, v array<long>")
    one = sets.toDF("a", "va")
    two = sets.toDF("b", "vb")
    overlap = F.size(F.array_intersect("va", "vb"))
    return pairs.join(one, "a").join(two, "b") \
        .where(100 * overlap >= percent * (F.size("va") + F.size("vb") - overlap)).select("a", "b").distinct()


def _cells(rows: DataFrame, *payload: str) -> DataFrame:
    """``rows`` ``(token, pos, cid, n, comp)`` dealt to blocks, sorted by block.

    The largest component of a bucket is never paired with itself: the others
    form left blocks of ``LEFT``, everything forms right blocks of ``RIGHT``.
    """
    per = rows.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token") \
        .agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"))
    per = per.where("m > top.c").select(
        "token", F.col("top.comp").alias("main"),
        F.ceil((F.col("m") - F.col("top.c")) / LEFT).cast("int").alias("nl"),
        F.ceil(F.col("m") / RIGHT).cast("int").alias("nr"), (F.col("m") <= SMALL).alias("small"))
    h = F.xxhash64("cid")
    base = rows.join(per, "token").withColumn("main", F.col("comp") == F.col("main"))
    right = base.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("l"),
                        F.pmod(h, F.col("nr")).cast("int").alias("r"))
    left = base.where("not main").select("*", F.lit(0).alias("side"), F.pmod(h, F.col("nl")).cast("int").alias("l"),
                                         F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("r"))
    cells = left.unionByName(right).select(
        F.xxhash64("token", "l", "r").alias("cell"), "side", "main", "small", "token", "pos", "cid", "n", "comp",
        *payload)
    return cells.repartition("cell").sortWithinPartitions("cell", "side")


def _cell_pairs(tab: pa.Table, percent: int):
    """Row pairs of different components in one block that sizes and places of
    the token allow, some at a time."""
    cell, side = tab.column("cell").to_numpy(), tab.column("side").to_numpy()
    cid, n, comp, pos = (tab.column(c).to_numpy() for c in ("cid", "n", "comp", "pos"))
    main = tab.column("main").to_numpy(zero_copy_only=False)
    at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.concatenate([at, [len(cell)]]))
    nl = np.add.reduceat((side == 0).astype(np.int64), at)
    many = nl * (size - nl)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(np.cumsum(many[i:]), 1 << 20, side="right")) + i)
        g = np.repeat(np.arange(i, j), many[i:j])
        at_pair = np.arange(len(g)) - np.repeat(np.cumsum(many[i:j]) - many[i:j], many[i:j])
        nr = (size - nl)[g]
        x, y = at[g] + at_pair // np.maximum(nr, 1), (at + nl)[g] + at_pair % np.maximum(nr, 1)
        ok = (comp[x] != comp[y]) & (main[y] | (cid[x] < cid[y])) & \
            (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        # as the first common token of the two: at most the smaller number of
        # tokens from it on can be common (every pair meets at its first one)
        most = np.minimum(n[x] - pos[x], n[y] - pos[y])
        ok = (100 + percent) * most >= percent * (n[x] + n[y])
        if ok.any():
            yield x[ok], y[ok]
        i = j


def _whole_cells(batches):
    """Tables of whole blocks from sorted batches."""
    held = None  # rows of the last block, which may go on in the next batch
    for b in batches:
        if not b.num_rows:
            continue
        tab = pa.Table.from_batches([b])
        tab = tab if held is None else pa.concat_tables([held, tab]).combine_chunks()
        cell = tab.column("cell").to_numpy()
        cut = int(np.searchsorted(cell, cell[-1]))
        held = tab.slice(cut)
        if cut:
            yield tab.slice(0, cut).combine_chunks()
    if held is not None:
        yield held.combine_chunks()


def _cross_pairs(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in the same bucket that sizes, places and
    the overlap bound allow.

    The first pass goes by sizes and places.  Small buckets give their possible
    pairs (at most ``SMALL`` a row); large ones only the rows that have any
    possible partner, and those meet again with their bucket counts.
    """
    def possible(batches):
        for tab in _whole_cells(batches):
            cid, token = tab.column("cid").to_numpy(), tab.column("token").to_numpy()
            small = tab.column("small").to_numpy(zero_copy_only=False)
            live, pairs = np.zeros(tab.num_rows, bool), []
            for x, y in _cell_pairs(tab, percent):
                k = small[x]
                pairs.append(np.stack([np.minimum(cid[x[k]], cid[y[k]]), np.maximum(cid[x[k]], cid[y[k]])], 1))
                live[x[~k]] = live[y[~k]] = True
            pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), axis=0)
            n, m = len(pairs), int(live.sum())
            none = np.arange(n + m) < n
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([pairs[:, 0], cid[live]])),
                 pa.array(np.concatenate([pairs[:, 1], np.zeros(m, np.int64)]), mask=~none),
                 pa.array(np.concatenate([np.zeros(n, np.int64), token[live]]), mask=none)], ["a", "b", "token"])

    def pairs(batches):
        for tab in _whole_cells(batches):
            cid, n, sketches = tab.column("cid").to_numpy(), tab.column("n").to_numpy(), tab.column("counts").to_pylist()
            for x, y in _cell_pairs(tab, percent):
                fine = bound_ok(n, sketches, x, y, percent)
                a, b = cid[x[fine]], cid[y[fine]]
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    found = stored(_cells(rows).mapInArrow(T.trimmed(possible), "a long, b long, token long").distinct(), "jaccard-possible")
    near = _bounded_pairs(found.where("token is null").select("a", "b"), classes, percent)
    live = found.where("token is not null").select("token", F.col("a").alias("cid"))
    fat = rows.join(live, ["token", "cid"]).join(classes.select("cid", "counts"), "cid")
    return near.unionByName(_cells(fat, "counts").mapInArrow(T.trimmed(pairs), "a long, b long")).distinct()


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3,
                       percent: int = 90) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` for every row of ``df``.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets
    of distinct ``k``-word shingles (A-Z lower-cased).  Null and empty texts
    have no shingles, link with nothing and are their own component.  Rows
    with a null id are kept with a null component.  Empty table: no rows.
    """
    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    frequent = frequent_shingles(narrow, "t", k)
    rows = stored(signatures(narrow, "id", "t", k, percent, frequent), "jaccard-rows")
    key = ["s1", "s2", "n"]
    classes = stored(rows.where("n > 0 and id is not null").groupBy(*key, "gid", "prefix", "counts").agg(
        F.min("id").alias("cid"), F.count("*").alias("copies")), "jaccard-classes")

    groups = stored(classes.groupBy("gid", "n").agg(F.min("cid").alias("rep"), F.sum("copies").alias("w")), "jaccard-groups")
    # one class of each group posts its tokens; most tokens are single and go
    # before anything else is attached
    posts = classes.join(groups.select(F.col("rep").alias("cid")), "cid", "left_semi") \
        .select(F.posexplode("prefix").alias("pos", "token"), F.col("cid").alias("rep"))
    common = posts.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    posted = stored(posts.join(common, "token"), "jaccard-posted").join(groups, "rep")
    pivots = posted.groupBy("token").agg(F.max(F.struct("w", -F.col("rep"), "n")).alias("p")) \
        .select("token", (-F.col("p.col2")).alias("pivot"), F.col("p.n").alias("pn"))
    shared = stored(posted.join(pivots, "token").select("token", "pos", "gid", "rep", "n", "pivot", "pn"), "jaccard-shared")

    inside = classes.join(groups.select("gid", "rep"), "gid").where("cid <> rep") \
        .select(F.col("rep").alias("a"), F.col("cid").alias("b"))
    across = shared.where(f"rep <> pivot and 100 * least(n, pn) >= {percent} * greatest(n, pn)").select(
        F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    first = stored(_bounded_pairs(inside.unionByName(across).distinct(), classes, percent), "jaccard-first")
    comp = stored(components(verified(first, narrow, "id", "t", k, percent)), "jaccard-comp")

    named = classes.join(comp.withColumnRenamed("id", "cid"), "cid", "left") \
        .select("cid", "gid", "n", F.coalesce("component_id", "cid").alias("comp"))
    span = named.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = shared.select("token", "pos", "gid").join(span, "gid")
    open_tokens = mixed.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    # a group is a bucket of its own classes: equal prefixes, so equal places
    buckets = mixed.join(open_tokens.select("token"), "token").select("token", "pos", "gid").unionByName(
        span.where("lo < hi").select(F.xxhash64("gid", F.lit("group")).alias("token"), F.lit(0).alias("pos"), "gid"))
    rows2 = stored(buckets.join(named, "gid").select("token", "pos", "cid", "n", "comp"), "jaccard-open")
    cross = stored(_cross_pairs(rows2, classes, percent), "jaccard-cross")
    links = verified(cross, narrow, "id", "t", k, percent)
    flat = named.select("cid", "comp")
    joined = components(links.join(flat.toDF("a", "ca"), "a").join(flat.toDF("b", "cb"), "b")
                        .select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    final = named.join(joined.toDF("comp", "root"), "comp", "left") \
        .select("cid", F.coalesce("root", "comp").alias("component_id"))
    of_class = classes.join(final, "cid").select(*key, "component_id")
    return rows.select("id", *key).join(of_class, key, "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
