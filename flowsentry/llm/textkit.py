"""Vectorised text helpers used inside Arrow tasks.

Texts of an Arrow batch are handled as one byte buffer in pieces of about
``CHUNK_BYTES`` (a longer text is one piece of its own), so the numpy
temporaries of a task stay bounded.  Words are maximal runs of word bytes;
their 64-bit hashes add up, over the bytes of a word, the byte's number times
a number for its place in the word, both drawn at random and alike in every
process, so that no rule of spelling makes two words collide.  The sums of all
words come from one prefix sum over the buffer.  Null texts are read as empty
texts.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_U = np.uint64

#: words `[^\x20\x09-\x0D]+`
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: lower-cases A-Z, leaves every other byte
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_MULT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SEED = 0x9E3779B97F4A7C15
_places = np.ones(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def place_keys(n: int) -> np.ndarray:
    """The numbers of the first n places of a word."""
    global _places
    if len(_places) < n:
        i = np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64)
        _places = mix(mix(i * _U(_SEED)) + _U(0x5851F42D4C957F2D))
    return _places[:n]


_caches: list = []
_owner = [None]


def cached_by_worker(clear) -> None:
    """Registers a function that empties a per-process cache."""
    _caches.append(clear)


def take_over(owner: str) -> None:
    """Called when a task starts: a reused Python worker that served another
    operator before gives that operator's caches and free memory back."""
    if _owner[0] not in (None, owner):
        for clear in _caches:
            clear()
        gc.collect()  # caches may hold cycles
        give_back()
    _owner[0] = owner


def give_back() -> None:
    """Returns free memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def trimmed(fn):
    """``fn`` over a task's batches, free memory given back when it ends: a
    reused worker waits for its next task, beside those that run, no larger
    than it needs."""
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()
    return run


class Words:
    """The words of some consecutive rows: byte ``start``/``end`` in ``buf``
    and the row number ``doc`` (relative to ``row0``) of each."""

    __slots__ = ("buf", "start", "end", "doc", "rows", "row0", "offs")

    def __init__(self, buf, offs, row0, lut):
        n = len(buf)
        self.buf, self.offs, self.row0, self.rows = buf, offs, row0, len(offs) - 1
        w = lut[buf]
        first = np.zeros(n + 1, bool)
        first[offs[:-1]] = True
        first[n] = False
        before = np.zeros(n, bool)
        before[1:] = w[:-1]
        after = np.zeros(n, bool)
        after[:-1] = w[1:]
        self.start = np.flatnonzero(w & (~before | first[:n]))
        self.end = np.flatnonzero(w & (~after | first[1:])) + 1
        self.doc = np.searchsorted(offs, self.start, side="right") - 1

    def __len__(self):
        return len(self.start)

    def hashes(self) -> np.ndarray:
        n, size = len(self.buf), self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        # place of every byte counted from the start of the word before it
        first = int(self.start[0])
        place = np.arange(first, n, dtype=np.int32)
        place -= np.repeat(self.start.astype(np.int32), np.diff(np.append(self.start, n)))
        np.minimum(place, int(size.max()), out=place)  # bytes between words count nowhere
        part = _BYTE[self.buf[first:]]
        part *= place_keys(int(size.max()) + 1)[place]
        total = np.zeros(n - first + 1, np.uint64)
        np.cumsum(part, out=total[1:], dtype=np.uint64)
        h = total[self.end - first] - total[self.start - first]
        return mix(h + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def hashes_lower(self) -> np.ndarray:
        """Hashes with A-Z lower-cased, for words read as they stand."""
        kept, self.buf = self.buf, LOWER[self.buf]
        h = self.hashes()
        self.buf = kept
        return h

    def text(self, i: int) -> str:
        return bytes(self.buf[self.start[i]:self.end[i]]).decode("utf-8", "replace")

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.rows)


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1] if offs else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offs


def row_pieces(offs: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of at most ``limit`` bytes (one row at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_pieces(col: pa.Array, lut=SPACE_WORD, lower: bool = True, limit: int = CHUNK_BYTES):
    """``Words`` of every piece of a string column."""
    data, offs = string_buffers(col)
    for i, j in row_pieces(offs, limit):
        buf = data[offs[i]:offs[j]]
        yield Words(LOWER[buf] if lower else buf, offs[i:j + 1] - offs[i], i, lut)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (length n - k + 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = h[:n] * _MULT[0]
    for j in range(1, k):
        s = s + h[j:n + j] * _MULT[j % 256] * _U(2 * (j // 256) + 1)
    return mix(s + _U(k))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def long_lists(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.Array:
    """A list array of ``counts[i]`` consecutive values each."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))
