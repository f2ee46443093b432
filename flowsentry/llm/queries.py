"""Registered queries of the numbered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsentry.llm import decontam, manifest, mixing, spelling, suffixes, vectors
from flowsentry.session import checkpoint_dir, ship_package, table_path

QUERIES: dict = {}
ORACLE: dict = {}


def piece_model() -> str:
    """Path of the public vocabulary file the contract names."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


#: Arrow batches sent to a Python task: rows and bytes
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20
#: rows that a scan decodes at a time, bytes that a Parquet writer gathers
#: before it writes them out: texts are long, and two tasks share a heap
SCAN_ROWS, WRITE_BYTES = 512, 32 << 20


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder and package of a session, and Arrow batches, scans and
    writers that stay small where texts are long (a larger row is a batch of its
    own)."""
    checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))
    spark.conf.set("parquet.block.size", str(WRITE_BYTES))


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn
    return register


@query("op3_pieces")
def op3(spark, sf_dir):
    from flowsentry.llm.pieces import piece_digest

    return piece_digest(table(spark, sf_dir, "documents"), piece_model())


@query("op8_token_counts")
def op8(spark, sf_dir):
    from flowsentry.llm.wordpiece import token_counts

    return token_counts(table(spark, sf_dir, "documents"), piece_model())


@query("op10_language")
def op10(spark, sf_dir):
    from flowsentry.llm.langid import language_of

    return language_of(table(spark, sf_dir, "documents"))


_OP4_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
one AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * i >= 90 * (a.n + b.n - i)),
link AS (SELECT x, y FROM one UNION ALL SELECT y, x FROM one),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON d.doc_id = r.x"""


@query("op4_jaccard", sql=_OP4_SQL)
def op4(spark, sf_dir):
    from flowsentry.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


@query("op2_repeats", sql=suffixes.ORACLE_SQL)
def op2(spark, sf_dir):
    return suffixes.repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_repeated", "n_removed")


@query("op9_decontamination", sql=decontam.ORACLE_SQL)
def op9(spark, sf_dir):
    return decontam.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_lm")
def op1(spark, sf_dir):
    from flowsentry.llm.lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@query("op5_vectors", sql=vectors.ORACLE_SQL)
def op5(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op6_shards")
def op6(spark, sf_dir):
    from flowsentry.llm.shards import sharded_documents

    return sharded_documents(table(spark, sf_dir, "documents"))


@query("op7_quality")
def op7(spark, sf_dir):
    from flowsentry.llm.quality import scored_documents

    return scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_mixing", sql=mixing.ORACLE_SQL)
def op11(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents"))


@query("op12_manifest", sql=manifest.ORACLE_SQL)
def op12(spark, sf_dir):
    return manifest.manifest_digest(table(spark, sf_dir, "documents"))


@query("op13_spelling", sql=spelling.ORACLE_SQL)
def op13(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
