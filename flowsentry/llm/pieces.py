"""SentencePiece (merge type) encoding and decoding.

The encoder never runs the merge queue over a text.  It walks left to right
taking the longest piece at each position (Aho-Corasick), accepts a piece
only when it is compatible with the one before (re-merging the two surfaces
gives exactly these two pieces), falls back to shorter pieces, and steps back
over a piece when none fits; positions found hopeless are cleared in a
bitfield so that none is tried twice.  A sequence whose neighbours are all
compatible is the merge result, so the ids equal the library's.

The model file is a parameter; tasks read it by path (a public file installed
on every worker) and keep one codec per process.  Models are merge type (BPE)
with identity normalisation, escaped white space and byte fallback.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import textkit as T

SPACE = "▁"
#: bounds of the per-process memo tables (results alike at any size)
MEMO_CHUNKS, MEMO_PAIRS, MEMO_LEN = 200_000, 200_000, 48
ROWS_BYTES = 1 << 21


class Surfaces:
    """What decoding needs of a model: the bytes that each id stands for."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.surface = [b""] * n
        self.byte_id = [0] * 256
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.surface[i] = bytes([int(piece[1:-1], 16)])
                self.byte_id[int(piece[1:-1], 16)] = i
            elif sp.is_control(i):
                continue
            elif sp.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            else:
                self.surface[i] = piece.replace(SPACE, " ").encode()
                self.ids[piece] = i
                self.rank[piece] = sp.get_score(i)
        self.is_byte = [sp.is_byte(i) for i in range(n)]

    def decode(self, ids) -> str:
        """Text of an id list: surfaces joined, byte pieces read as UTF-8
        (U+FFFD for each byte that is none), the leading mark dropped."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        raw = b"".join(map(self.surface.__getitem__, ids))
        if ids and raw[:1] == b" " and not self.is_byte[ids[0]]:
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


class _Memo(dict):
    """Ids of the chunks met lately.  A full table becomes the old one, whose
    chunks come back when they are met again: frequent ones stay."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            got = self.encode(chunk)
            if len(chunk) > MEMO_LEN:
                return got
        if len(self) >= MEMO_CHUNKS // 2:
            self.old = dict(self)
            self.clear()
        self[chunk] = got
        return got

    def empty(self):
        self.old = {}
        self.clear()


class PieceCodec(Surfaces):
    def __init__(self, model_path: str):
        import ahocorasick

        super().__init__(model_path)
        self.auto = ahocorasick.Automaton()
        self.known = {c for p in self.ids for c in p}
        # a piece that merging never leaves alone is no candidate
        whole = [p for p in {*self.ids, *self.known} if self.remerge(p) == [p]]
        self.edges: dict[tuple[str, bool], list | None] = {}
        # nodes (piece, length, node of the longest shorter piece, ids, and by
        # piece the first node of its line of shorter pieces that fits after it)
        nodes: dict[str, tuple] = {}
        for p in sorted(whole, key=len):
            cut = next((nodes[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in nodes), None)
            ids = [self.ids[p]] if p in self.ids else [self.byte_id[b] for b in p.encode()]
            nodes[p] = (p, len(p), cut, array("i", ids).tobytes(), {})
            if len(p) > 1:
                self.auto.add_word(p, (len(p) - 1, nodes[p]))
        self.auto.make_automaton()
        self.single = {c: nodes[c] for c in self.known}
        # a boundary that no piece spans: something before a white-space mark
        spans = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.chunk_re = re.compile(".+" if spans else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
        self.nodes, self.pairs = list(nodes.values()), 0
        self.memo = _Memo(self._chunk)

    def remerge(self, s: str) -> list[str]:
        """Merge result of a short string: best score first, leftmost on ties."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, piece: str, right: bool):
        """Merge history of one edge of a piece: ``(part, born, used)`` from the
        edge character to the piece itself, with the scores at which the part
        is formed and merged away.  None where a merge scores better than the
        parts it joins (its moment is then not its score)."""
        born, gone = {i: float("inf") for i in range(len(piece))}, []
        parts = [(i, i + 1) for i in range(len(piece))]
        edge = [(parts[-1] if right else parts[0], float("inf"))]
        while len(parts) > 1:
            r, i = max((self.rank.get(piece[parts[i][0]:parts[i + 1][1]], -float("inf")), -i)
                       for i in range(len(parts) - 1))
            i = -i
            if r > min(born[parts[i][0]], born[parts[i + 1][0]]):
                return None
            born[parts[i][0]] = r
            parts[i:i + 2] = [(parts[i][0], parts[i + 1][1])]
            if i == (len(parts) - 1 if right else 0):
                gone.append(r)
                edge.append((parts[i], r))
        gone.append(-float("inf"))
        return [(piece[a:b], s, g) for ((a, b), s), g in zip(edge, gone)]

    def _edge_of(self, piece: str, right: bool):
        key = (piece, right)
        if key not in self.edges:
            self.edges[key] = self._edge(piece, right)
        return self.edges[key]

    def fits(self, left: str, right: str) -> bool:
        """Does merging ``left + right`` give back exactly these two pieces?
        Only merges across the seam could differ: a part of the left piece's
        right edge with a part of the right piece's left edge, while both are
        there and before either is merged away (ties: leftmost first)."""
        a, b = self._edge_of(left, True), self._edge_of(right, False)
        if a is None or b is None:
            return self.remerge(left + right) == [left, right]
        rank = self.rank
        for x, sx, gx in a:
            for y, sy, gy in b:
                r = rank.get(x + y)
                if r is not None and r > gx and r >= gy and sx > gy and sy > gx:
                    return False
        return True

    def _fitting(self, left: tuple, node: tuple) -> tuple | None:
        """The longest of ``node`` and its shorter pieces that fits after
        ``left``; noted for all that were tried."""
        known, tried = left[4], []
        while node is not None and node[0] not in known:
            tried.append(node[0])
            if self.fits(left[0], node[0]):
                break
            node = node[2]
        else:
            node = None if node is None else known[node[0]]
        if self.pairs + len(tried) > MEMO_PAIRS:
            for n in self.nodes:
                n[4].clear()
            self.pairs = 0
        self.pairs += len(tried)
        known.update(dict.fromkeys(tried, node))
        return node

    def _segment(self, s: str) -> list[tuple]:
        """Backtracking over one run of known characters."""
        size = len(s)
        longest = [*map(self.single.get, s), None]
        for end, (back, node) in self.auto.iter(s):  # later matches of one start are longer
            longest[end - back] = node
        alive, stuck = bytearray(b"\xff") * ((size >> 3) + 1), False
        out: list[tuple] = []
        at, node = 0, longest[0]
        while at < size:
            if out and node is not None:
                left = out[-1]
                try:
                    node = left[4][node[0]]
                except KeyError:
                    node = self._fitting(left, node)
            if node is None:  # nothing fits here: give up this position and step back
                alive[at >> 3] &= ~(1 << (at & 7))
                stuck = True
                last = out.pop()
                at -= last[1]
                node = last[2]
                continue
            end = at + node[1]
            if stuck and not alive[end >> 3] >> (end & 7) & 1:
                node = node[2]
                continue
            out.append(node)
            at = end
            node = longest[at]
        return out

    def _chunk(self, chunk: str) -> bytes:
        if self.known.issuperset(chunk):
            return b"".join([node[3] for node in self._segment(chunk)])
        parts: list[bytes] = []
        run = 0
        for i, c in enumerate(chunk):
            if c not in self.known:
                parts += (node[3] for node in self._segment(chunk[run:i]))
                parts.append(array("i", [self.byte_id[b] for b in c.encode()]).tobytes())
                run = i + 1
        parts += (node[3] for node in self._segment(chunk[run:]))
        return b"".join(parts)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        chunks = self.chunk_re.findall(SPACE + text.replace(" ", SPACE))
        return np.frombuffer(b"".join(map(self.memo.__getitem__, chunks)), np.int32)


@lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


@lru_cache(maxsize=2)
def surfaces(model_path: str) -> Surfaces:
    return Surfaces(model_path)


T.cached_by_worker(codec.cache_clear)
T.cached_by_worker(surfaces.cache_clear)


def _rows(batch: pa.RecordBatch, step):
    """Slices of a batch with at most about ``ROWS_BYTES`` of column data."""
    n = max(1, batch.num_rows * ROWS_BYTES // max(batch.nbytes, 1))
    for i in range(0, batch.num_rows, n):
        yield step(batch.slice(i, n))


def encode_pieces(df: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` plus ``out``: the ids of the whole text, without begin or end ids.

    Null and empty texts give an empty list.  An existing column called
    ``out`` is replaced; all others pass unchanged.
    """
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    df = df.drop(out)
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(IntegerType(), False))])

    def run(batches):
        T.take_over("pieces")
        c = codec(model_path)

        def step(part):
            got = [c.encode(t or "") for t in part.column(text).to_pylist()]
            offs = np.zeros(len(got) + 1, np.int32)
            np.cumsum([len(x) for x in got], out=offs[1:])
            ids = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([*got, np.zeros(0, np.int32)])))
            return pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, out])

        try:
            for b in batches:
                yield from _rows(b, step)
        finally:
            c.memo.empty()  # a reused worker keeps no texts of this task

    return df.mapInArrow(T.trimmed(run), schema)


def decode_pieces(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` plus ``out``: the text of the id list (null list: empty text)."""
    from pyspark.sql.types import StringType, StructField, StructType

    df = df.drop(out)
    schema = StructType([*df.schema.fields, StructField(out, StringType())])

    def run(batches):
        T.take_over("pieces")
        c = surfaces(model_path)

        def step(part):
            col = part.column(ids)
            texts = [c.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in col]
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out])

        for b in batches:
            yield from _rows(b, step)

    return df.mapInArrow(T.trimmed(run), schema)


def piece_digest(df: DataFrame, model_path: str) -> DataFrame:
    """Per document: id count and SHA-256 of the ids and of the decoded text."""
    both = decode_pieces(encode_pieces(df.select("doc_id", "text"), model_path).drop("text"), model_path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
