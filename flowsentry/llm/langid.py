"""Language identification by hyperdimensional profiles.

Every letter symbol has a random +1/-1 vector.  A letter trigram is the
product of its letters' vectors, each rotated by its place; a text is the sum
of its trigrams; a language is the sum of its training texts.  A text gets
the language whose prototype has the largest cosine with it.

Symbols: 0 is any run of non-letters (word boundary), 1-26 a-z, and the
remaining code points share 37 symbols by code point, so every script has a
profile.  Training needs only trigram counts per language (at most 64^3 rows
each), which Spark adds up over all training texts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import textkit as T

SYMBOLS, DIMENSIONS, SEED = 64, 1024, 11
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of every code point, upper case as its lower case."""
    low = (chr(c).lower() for c in range(0x110000))
    cps = np.fromiter((ord(x[0]) for x in low), np.int64, 0x110000)  # U+0130 alone has two characters: i and a dot
    sym = (27 + cps % (SYMBOLS - 27)).astype(np.uint8)
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    sym[~letter] = 0
    latin = letter & (cps >= 97) & (cps <= 122)
    sym[latin] = cps[latin] - 96
    return sym


@lru_cache(maxsize=2)
def letter_vectors(dims: int = DIMENSIONS, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Vectors at the first, second and third place of a trigram."""
    v = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dims))
    return np.roll(v, 2, 1), np.roll(v, 1, 1), v


def trigram_vectors(codes: np.ndarray, dims: int) -> np.ndarray:
    a, b, c = letter_vectors(dims)
    return a[codes >> 12] * b[codes >> 6 & 63] * c[codes & 63]


def trigram_counts(col: pa.Array, limit: int = 1 << 17):
    """For pieces of a string column: (first row, rows, row, trigram, count,
    whether each row has a letter).  Texts start and end with a boundary."""
    data, offs = T.string_buffers(col)
    table = symbol_table()
    for i, j in T.row_pieces(offs, limit):
        raw = bytes(data[offs[i]:offs[j]])
        # byte offsets to code point offsets
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(lead)])[offs[i:j + 1] - offs[i]]
        text = raw.decode("utf-8", "replace")
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(cps) != at[-1]:
            cps = np.frombuffer("".join(c if c < "\ud800" or c > "\udfff" else " " for c in text)
                                .encode("utf-32-le"), np.uint32)
        rows = j - i
        sym = np.insert(table[np.minimum(cps, 0x10FFFF)], at, 0)  # a boundary between texts
        doc = np.repeat(np.arange(rows + 1), np.diff(np.concatenate([[0], at, [len(cps)]]))[1:rows + 2]
                        + 1) if rows else np.zeros(0, int)
        keep = np.ones(len(sym), bool)
        keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
        sym, doc = sym[keep].astype(np.int64), doc[keep]
        code = sym[:-2] << 12 | sym[1:-1] << 6 | sym[2:]
        owner = doc[1:-1]  # the middle symbol is a letter or a boundary of this text
        good = sym[1:-1] != 0
        both, n = np.unique(owner[good] << 18 | code[good], return_counts=True)
        yield i, rows, both >> 18, both & 0x3FFFF, n, np.bincount(owner[good], minlength=rows)[:rows] > 0


def train_profiles(df: DataFrame, text: str = "text", lang: str = "lang", dims: int = DIMENSIONS) -> dict:
    """Unit prototype vectors ``{lang: vector}`` of the rows with a language.

    Spark counts trigrams per language over all rows; each language's counts
    (at most 64^3) become one prototype in a task of its own.  Null languages
    and texts without letters teach nothing; no rows give an empty model.
    """
    def count(batches):
        T.take_over("langid")
        for b in batches:
            texts, langs = b.column(0), b.column(1).dictionary_encode()
            names, code = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            total = {}
            for i, rows, row, tri, n, _ in trigram_counts(texts, 1 << 20):
                key, inv = np.unique(code[i:i + rows][row] << 18 | tri, return_inverse=True)
                for k, v in zip(key.tolist(), np.bincount(inv, n).astype(np.int64).tolist()):
                    total[k] = total.get(k, 0) + v
            k = np.fromiter(total, np.int64, len(total))
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(k >> 18)), pa.array(k & 0x3FFFF), pa.array(list(total.values()), pa.int64())],
                ["lang", "tri", "n"])

    counts = df.where(F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l")) \
        .mapInArrow(T.trimmed(count), "lang string, tri long, n long").groupBy("lang", "tri").agg(F.sum("n").alias("n"))

    def bundle(pdf):
        import pandas as pd

        v = np.zeros(dims)
        for i in range(0, len(pdf), 8192):
            part = pdf.iloc[i:i + 8192]
            v += part.n.to_numpy("f8") @ trigram_vectors(part.tri.to_numpy(), dims)
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "v": [(v / max(np.linalg.norm(v), 1e-300)).tolist()]})

    rows = counts.groupBy("lang").applyInPandas(bundle, "lang string, v array<double>").collect()
    return {r["lang"]: np.array(r["v"]) for r in sorted(rows, key=lambda r: r["lang"])}


def identify(df: DataFrame, profiles: dict, text: str = "text", out: str = "lang_pred",
             score: str = "score", lettered: str | None = None, keep_text: bool = True) -> DataFrame:
    """``df`` plus ``out`` and ``score``.

    ``score`` is the cosine with the chosen prototype, 0 where negative.  Ties
    go to the first language in sorted order.  A text that is null or has no
    letter, and any text under an empty model, gets ``und`` and 0.  Existing
    columns with the output names are replaced.  ``lettered`` names a further
    column that says whether the text has a letter, whatever the label.
    Without ``keep_text`` the text itself is left out.
    """
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    flag = [lettered] if lettered else []
    df = df.drop(out, score, *flag)
    kept = [i for i, c in enumerate(df.columns) if keep_text or c != text]
    schema = StructType([*(df.schema.fields[i] for i in kept), StructField(out, StringType()), StructField(score, DoubleType()),
                         *(StructField(c, BooleanType()) for c in flag)])
    names = [*profiles, UNDETERMINED]
    proto = np.array([*profiles.values()], np.float32).T if profiles else None
    dims = 0 if proto is None else proto.shape[0]

    def run(batches):
        T.take_over("langid")
        for b in batches:
            pick = np.full(b.num_rows, len(names) - 1)
            best = np.zeros(b.num_rows)
            some = np.zeros(b.num_rows, bool)
            for i, rows, row, tri, n, has in trigram_counts(b.column(b.schema.names.index(text))):
                some[i:i + rows] = has
                if proto is None or not len(tri):
                    continue
                used, col = np.unique(tri, return_inverse=True)
                x = np.zeros((rows, dims), np.float32)
                counts = np.zeros((rows, min(len(used), 4096)), np.float32)
                for k in range(0, len(used), 4096):  # bounded: 4096 trigram vectors at a time
                    part = (col >= k) & (col < k + 4096)
                    counts[:] = 0
                    counts[row[part], col[part] - k] = n[part]
                    vectors = trigram_vectors(used[k:k + 4096], dims).astype(np.float32)
                    x += counts[:, :len(vectors)] @ vectors
                cos = (x @ proto) / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None]
                top = np.argmax(cos, axis=1)
                pick[i:i + rows] = np.where(has, top, len(names) - 1)
                best[i:i + rows] = np.where(has, np.clip(cos[np.arange(rows), top], 0, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in kept), pa.array(names).take(pa.array(pick)), pa.array(best), *(pa.array(some) for _ in flag)],
                schema.names)

    return df.mapInArrow(T.trimmed(run), schema)


def held_out(remainder: int, modulus: int, id_col: str = "doc_id"):
    """The documented split: crc32 of the id's decimal text by a modulus."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder


def language_of(docs: DataFrame) -> DataFrame:
    """Digest of the whole table, learned from the training rows."""
    split = F.coalesce(held_out(1, 3), F.lit(False))
    profiles = train_profiles(docs.where(~split))
    return identify(docs.select("doc_id", split.alias("held_out"), "text"), profiles) \
        .select("doc_id", "held_out", "lang_pred", "score")
