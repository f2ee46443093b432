"""Corpus pipeline: language, near-duplicates, repeated passages, benchmark
passages, token pieces.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the next stage's documents.  All stages but the last return the
columns of ``documents`` and change rows only by their decision:

1. ``language``: adds up letter profiles of the rows' own ``lang`` values,
   compares every text with them, and drops the rows whose text has no letter
   (or is null) or resembles no learned language (best cosine not above
   ``LEAST_COSINE``).  ``lang`` of the rows that stay, which the last stage
   returns, becomes the language their text resembles most where they have no
   label, or another one and a cosine above ``SURE_COSINE``.  Without any learned language all lettered rows stay as they are.
2. ``near_duplicates``: of each component of texts whose five-word shingle
   sets reach a Jaccard similarity of 0.8, the smallest ``doc_id`` stays (a row
   without an id only where no row of its component has one).  Texts without
   words are never duplicates; rows with equal ids and texts are one.
3. ``repeated_passages``: cuts passages of 50 words or more that an earlier
   row holds (``n_chars`` follows the new text); rows cut whole go.
4. ``decontamination``: drops rows that hold a window of a benchmark item.
5. ``pieces``: SentencePiece ids, the text decoded from them, and its language.

Stages 2 to 4 know a row by its id and text, so rows that share an id (or have
none) are each judged by their own text; in stage 3 those without an id come
after all others.  Columns of any name pass through.  An empty table gives empty stages.  ``ORACLE_SQL`` is None: stages 1 and 5 cannot be
written in SQL; tests hold the pipeline against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.llm import decontam, jaccard, langid, pieces, queries, suffixes
from flowsentry.llm.queries import table
from flowsentry.session import scratch_path


#: cosine that a text must be above with some language (0: none in common)
LEAST_COSINE = 0.0
#: cosine above which the language found takes the place of another label (words
#: of few letters resemble the wrong language too often)
SURE_COSINE = 0.5


def _packed(docs: DataFrame, *apart: str) -> DataFrame:
    """``user`` (a struct of the columns not named), ``id, t, th``: names of the
    table's own columns cannot meet those of a stage."""
    user = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in apart))
    return docs.select(user.alias("user"), F.col("doc_id").alias("id"), F.col("text").alias("t"), F.xxhash64("text").alias("th"))


def _sized(df: DataFrame) -> DataFrame:
    """A stored table, broadcast only up to a checked number of rows."""
    return F.broadcast(df) if df.count() <= suffixes.BROADCAST_ROWS else df


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.prepare(spark)
    profiles = langid.train_profiles(docs)
    rows = _packed(docs)
    judged = langid.identify(rows.select("id", "t", "th", F.col("user").getField("lang").alias("lang")), profiles,
                             text="t", lettered="lettered", keep_text=False)
    alien = (F.col("score") <= LEAST_COSINE) if profiles else F.lit(False)
    sure = F.col("score") > SURE_COSINE
    other = F.col("lang").isNull() | ((F.col("lang_pred") != F.col("lang")) & sure) if profiles else F.lit(False)
    # the rows that go or get another label; one verdict for an id and text
    verdict = judged.select("id", "th", "lang_pred", (~F.col("lettered") | alien).alias("gone"), sure.alias("sure"), other.alias("other")) \
        .where("gone or other").groupBy("id", "th").agg(
            F.min("lang_pred").alias("found"), F.bool_or("gone").alias("gone"), F.bool_or("sure").alias("sure"))
    verdict = _sized(jaccard.stored(verdict, "pipeline-language-verdicts"))
    same = rows["id"].eqNullSafe(verdict["id"]) & (rows["th"] == verdict["th"])
    left = rows.join(verdict, same, "left").where("gone is null or not gone")
    own = F.col("user").getField("lang")
    lang = F.when(own.isNull() | F.col("sure"), F.coalesce("found", own)).otherwise(own)
    return left.select(F.col("user").withField("lang", lang).alias("user")).select("user.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.prepare(spark)
    rows = _packed(docs)
    # texts that share an id, or have none, get a number of their own
    ids = jaccard.stored(rows.groupBy("id", "th").agg(F.count("*").alias("copies")), "pipeline-ids")
    twice = ids.where("id is not null").groupBy("id").agg(F.count("*").alias("texts")).where("texts > 1").select("id")
    own = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("-")), "th").alias("own")
    many = ids.where("id is not null").join(twice, "id").unionByName(ids.where("id is null")).select(
        F.col("id").alias("of"), F.col("th").alias("of_text"), own)
    many = _sized(jaccard.stored(many, "pipeline-shared-ids"))
    keyed = rows.join(many, rows["id"].eqNullSafe(many["of"]) & (F.col("th") == F.col("of_text")), "left").select(
        "user", "id", "t", "th", F.coalesce("own", F.col("id").cast("long")).alias("row"))
    classes = jaccard.stored(jaccard.jaccard_components(keyed, "row", "t", k=5, percent=80).select(
        "row", "component_id").distinct(), "pipeline-classes")
    linked = classes.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    named = classes.join(linked, "component_id").join(many, F.col("row") == F.col("own"), "left")
    id_of = F.when(F.col("own").isNull(), F.col("row")).otherwise(F.col("of"))
    named = named.select("component_id", F.struct(id_of.isNull().alias("none"), id_of.alias("id"),
                                                  F.col("of_text").alias("th"), "row").alias("at"))
    first = named.groupBy("component_id").agg(F.min("at").alias("first"))
    gone = _sized(jaccard.stored(named.join(first, "component_id").where("at.row <> first.row").select(
        F.col("at.row").alias("gone")), "pipeline-copies"))
    left = keyed.join(gone, F.col("row") == F.col("gone"), "left_anti")
    # a row that comes again with the same id and text is a copy as well
    again = _sized(jaccard.stored(ids.where("copies > 1").select("id", "th"), "pipeline-again"))
    same = left["id"].eqNullSafe(again["id"]) & (left["th"] == again["th"])
    once = left.join(again, same, "left_anti").select("user.*")
    return once.unionByName(left.join(again, same, "left_semi").dropDuplicates(["id", "t"]).select("user.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.prepare(spark)
    rows = _packed(docs, "text").select("user", "id", "t", F.length("t").alias("before"))
    cut = suffixes.drop_repeats(rows, "id", "t", null_ids=True)

    def column(c: str):
        if c == "text":
            return F.col("t").alias(c)
        same = F.col("user").getField(c)
        if c != "n_chars":
            return same.alias(c)
        kind = docs.schema[c].dataType
        return F.when(F.length("t") != F.col("before"), F.length("t").cast(kind)).otherwise(same).alias(c)
    return cut.select(*(column(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.prepare(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.prepare(spark)
    model = queries.piece_model()
    both = pieces.decode_pieces(pieces.encode_pieces(docs.select("doc_id", "lang", "text"), model).drop("text"), model)
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("decoded").alias("text"), "lang")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("pieces", token_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage is written as
    Parquet below the shared checkpoint folder and read again."""
    queries.prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
