"""File readers and writers.

Raw files are read with an explicit schema (never inferred: inference costs
a pass and one '-' flips a column's type); dirty numerics stay STRING until
the cleaning expressions parse them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOW_RAW = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("proto", T.StringType()),
    T.StructField("duration", T.StringType()),
    T.StructField("src_bytes", T.StringType()),
    T.StructField("dst_bytes", T.StringType()),
    T.StructField("src_pkts", T.StringType()),
    T.StructField("dst_pkts", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

SENSOR_COLUMNS = 27
SENSOR_RAW = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(SENSOR_COLUMNS)])

PACKET_RAW = T.StructType([
    T.StructField("frame", T.StringType()), T.StructField("rel", T.StringType()),
    T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()),
    T.StructField("proto", T.StringType()), T.StructField("size", T.StringType()),
    T.StructField("info", T.StringType()),
])

DEVICE_STATS = T.StructType([
    T.StructField("sample", T.LongType()), T.StructField("cpu_pct", T.DoubleType()),
    T.StructField("mem_mb", T.DoubleType()), T.StructField("status", T.StringType()),
])

METRIC_SAMPLES = T.StructType([
    T.StructField("metric", T.StringType()), T.StructField("device", T.IntegerType()),
    T.StructField("ts", T.DoubleType()), T.StructField("seq", T.LongType()),
    T.StructField("value", T.DoubleType()),
])


def read_flows(spark: SparkSession, path: str, fmt: str = "csv",
               schema: T.StructType = FLOW_RAW) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


LINE = "_line"


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, header: str | None = None, sep: str = ",",
                     streaming: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)`` of a delimited file: every line is in one of them.

    A line with a field too few or too many, a quote that is not closed, or a
    field its column cannot hold lands in ``rejects`` with the raw ``line`` and
    the ``reason``; it is neither padded nor cut nor guessed.  Lines are read as
    text and parsed with a corrupt-record column, so each is at hand whole.  A
    doubled quote stands for one.  Lines equal to ``header`` and empty lines are
    no lines.
    """
    wide = T.StructType([*schema.fields, T.StructField(LINE, T.StringType())])
    raw = (spark.readStream if streaming else spark.read).text(path).where(F.length(F.trim("value")) > 0)
    if header is not None:
        raw = raw.where(F.col("value") != F.lit(header))
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": LINE}
    line = F.col("value")
    rows = raw.select(line, F.from_csv(line, wide.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("r"))
    open_quote = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    n = F.size(F.split(F.regexp_replace(line, '"[^"]*"', ""), f"\\Q{sep}\\E"))
    reason = F.when(open_quote, "open quote").when(F.col(f"r.{LINE}").isNotNull(), F.when(
        n < len(schema), "too few fields").when(n > len(schema), "too many fields").otherwise("bad value"))
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select(*[F.col(f"r.{c}").alias(c) for c in schema.names]), \
        rows.where("reason is not null").select(line.alias("line"), "reason")


def read_sensor(spark: SparkSession, path: str) -> DataFrame:
    """Sensor trace by position: 0 = epoch seconds, 2 = device ip, 3 = temperature."""
    raw = spark.read.schema(SENSOR_RAW).option("header", True).csv(path)
    return raw.select(F.col("c0").try_cast("double").alias("epoch"),
                      F.col("c2").alias("ip"),
                      F.col("c3").try_cast("double").alias("temp"))


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packet trace by position: frame, relative time, src, dst, protocol, size, info.

    Time and size stay text here; ``alignment.parse_packets`` types them and
    routes unparseable rows to rejects.
    """
    raw = spark.read.schema(PACKET_RAW).option("header", True).csv(path)
    return raw.select(F.col("frame").try_cast("bigint").alias("frame"), "rel", "src", "dst",
                      "proto", "size", "info")


def read_device_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DEVICE_STATS).option("header", True).option("sep", "\t").csv(path)


def read_metrics(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Long metric-sample table (parquet), as a batch or a stream."""
    if streaming:
        return spark.readStream.schema(METRIC_SAMPLES).parquet(path)
    return spark.read.schema(METRIC_SAMPLES).parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines ``(source, line, text)``: the source is a ``source=<name>``
    folder or the file name, lines count from 1 through the source's files in
    name order.

    A file may be read in several splits: lines are numbered inside each split
    and shifted by the lines of the splits before it (one row per split).
    """
    df = spark.read.text(path)
    source = F.col("source") if "source" in df.columns else F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    d = df.select(source.cast("string").alias("source"), F.col("value").alias("text"),
                  F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                  F.monotonically_increasing_id().alias("_id"))
    split = ["source", "_file", "_start"]
    number = F.row_number().over(Window.partitionBy(*split).orderBy("_id"))
    before = d.groupBy(*split).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_file", "_start")
                                               .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return d.withColumn("_number", number).join(before, split) \
            .select("source", (F.col("_before") + F.col("_number")).cast("bigint").alias("line"), "text")


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Report sink: a directory of CSV (with header) or parquet parts."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_flows_by_day(df: DataFrame, path: str, ts: str = "ts", mode: str = "overwrite") -> None:
    """Flow sink partitioned by UTC day (epoch-seconds ``ts``): later reads
    with a time filter prune whole day folders."""
    day = F.to_date(F.timestamp_seconds(F.col(ts)))
    df.withColumn("day", day).write.mode(mode).partitionBy("day").parquet(path)


def read_flows_between(spark: SparkSession, path: str, start_s: float, end_s: float,
                       ts: str = "ts") -> DataFrame:
    """Flows with ``start_s <= ts < end_s`` from a day-partitioned sink; the
    day predicate prunes partitions, the ts predicate is pushed to the scan."""
    df = spark.read.parquet(path)
    d0 = F.to_date(F.timestamp_seconds(F.lit(float(start_s))))
    d1 = F.to_date(F.timestamp_seconds(F.lit(float(end_s))))
    return df.where((F.col("day") >= d0) & (F.col("day") <= d1)
                    & (F.col(ts) >= start_s) & (F.col(ts) < end_s))


def write_sensor_csv(df: DataFrame, path: str) -> None:
    """Sensor rows as the 27-column positional CSV (fillers 'False')."""
    cols = [F.col("epoch").cast("string").alias("c0"), F.lit("2").alias("c1"),
            F.col("ip").alias("c2"), F.col("temp").cast("string").alias("c3")]
    cols += [F.lit("False").alias(f"c{i}") for i in range(4, SENSOR_COLUMNS)]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_packets_csv(df: DataFrame, path: str) -> None:
    df.select(F.col("frame").cast("string"), F.col("rel").cast("string"), "src", "dst",
              "proto", "size", "info").write.mode("overwrite").option("header", True).csv(path)
