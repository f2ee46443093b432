"""Token counts by greedy longest match over a word-piece vocabulary.

The vocabulary is a trie.  Every node carries a failure link and the number
of pieces that are popped when the link is taken, so a word is counted in one
pass over its characters (no re-reading, no piece strings).  Word pieces are
read off a SentencePiece file: pieces with the word mark start a word, pieces
without it continue one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowsentry.llm import textkit as T

SPACE = "▁"
MEMO_WORDS = 500_000


class LongestMatch:
    """Counts pieces of a word.  ``starts``/``rest``: pieces that begin or
    continue a word; ``""`` in ``starts`` is a bare word mark.  A word that
    greedy matching cannot cover counts as one unknown token."""

    def __init__(self, starts, rest):
        self.next: list[dict[str, int]] = [{}, {}]
        self.fail: list[int] = [-1, -1]   # -1: no way on
        self.pops: list[int] = [0, 0]
        piece = [False, False]
        for root, words in ((0, starts), (1, rest)):
            for w in words:
                u = root
                for ch in w:
                    v = self.next[u].get(ch)
                    if v is None:
                        v = self.next[u][ch] = len(self.next)
                        self.next.append({})
                        self.fail.append(-1)
                        self.pops.append(0)
                        piece.append(False)
                    u = v
                if w or root == 0:
                    piece[u] = True
        if piece[0]:
            self.fail[0], self.pops[0] = 1, 1
        level = [0, 1]
        while level:  # breadth first: links of shorter strings are ready
            deeper = []
            for u in level:
                for ch, v in self.next[u].items():
                    if piece[v]:
                        self.fail[v], self.pops[v] = 1, 1
                    else:
                        n, z = self.pops[u], self.fail[u]
                        while z >= 0 and ch not in self.next[z]:
                            n += self.pops[z]
                            z = self.fail[z]
                        if z >= 0:
                            self.fail[v], self.pops[v] = self.next[z][ch], n
                    deeper.append(v)
            level = deeper

    def count(self, word: str) -> int:
        """Number of pieces; 0 if the word cannot be covered."""
        nxt, fail, pops = self.next, self.fail, self.pops
        u = n = 0
        for ch in word:
            while ch not in nxt[u]:
                if fail[u] < 0:
                    return 0
                n += pops[u]
                u = fail[u]
            u = nxt[u][ch]
        while u != 1:
            if fail[u] < 0:
                return 0
            n += pops[u]
            u = fail[u]
        return n


def read_vocabulary(model_path: str) -> tuple[list[str], list[str]]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    starts = [p[1:] for p in pieces if p.startswith(SPACE) and SPACE not in p[1:]]
    return starts, [p for p in pieces if SPACE not in p]


@lru_cache(maxsize=2)
def matcher(model_path: str) -> LongestMatch:
    return LongestMatch(*read_vocabulary(model_path))


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_words``, ``n_tokens`` (an uncovered word is one
    token) and ``n_unknown`` words of the whole text.  Null or empty: zeros."""
    from pyspark.sql.types import LongType, StructField, StructType

    df = df.select(id_col, text)
    schema = StructType([df.schema[id_col], *(StructField(c, LongType(), False)
                                              for c in ("n_words", "n_tokens", "n_unknown"))])

    def run(batches):
        m = matcher(model_path)
        memo: dict[int, int] = {}
        for b in batches:
            for w in T.word_pieces(b.column(1), lower=False):
                keys, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                n = np.empty(len(keys), np.int64)
                for i, key in enumerate(keys.tolist()):
                    got = memo.get(key)
                    if got is None:
                        got = memo[key] = m.count(w.text(first[i]))
                    n[i] = got
                n = n[inverse]
                unknown = np.bincount(w.doc, n == 0, w.rows).astype(np.int64)
                tokens = np.bincount(w.doc, n, w.rows).astype(np.int64) + unknown
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(w.row0, w.rows), pa.array(w.per_doc().astype(np.int64)),
                     pa.array(tokens), pa.array(unknown)], schema.names)

    return df.mapInArrow(run, schema)
