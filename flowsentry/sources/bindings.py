"""Bindings: flow, metric, trace, score, measurement and log tables derived
from the driver's base tables.

Each binding exists twice, as a Spark DataFrame builder and as a DuckDB
common table expression with the same rows, so that every registered query
can be checked against an independent SQL engine.  The DuckDB text is only
an oracle; the Spark side is what runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.functions.scalar import epoch_seconds
from flowsentry.operators.prefix import running_aggregate
from flowsentry.sources.tables import read_table

# Window size of the flow binding (10 s windows would hold single flows).
FLOW_WINDOW_SECONDS = 3600.0
# Window size of the lineitem-derived bench binding.
FLOWS_LI_WINDOW_SECONDS = 86400.0


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        epoch_seconds(e, "ts").alias("ts"),
        "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (dirty) flow records, one per event; attack hours are 02:00-03:59.
    Outside them half the flows are invalid (duration 0), so attack windows
    really hold more valid flows."""
    e = ev(spark, sf_dir)
    hot = F.pmod(F.floor(F.col("ts") / 3600).cast("bigint"), F.lit(24)).isin(2, 3)
    k = F.col("k")
    s = lambda c: c.cast("string")
    return (
        e.withColumn("hot", hot)
        .select(
            "event_id", "ts",
            F.concat(F.lit("10.0.0."), s(F.col("user_id"))).alias("src_ip"),
            F.when(F.col("event_type") == "signup", "icmp")
             .when(F.col("event_type") == "error", "udp").otherwise("tcp").alias("proto"),
            F.when(~F.coalesce(F.col("hot") | (k < 50), F.lit(False)), "0")
             .when((F.col("event_type") == "signup") & (k % 2 == 0), "-")
             .when(F.col("event_type") == "signup", "0")
             .otherwise(s(F.col("value"))).alias("duration"),
            F.when(k % 7 == 0, "-").otherwise(s(k * 13)).alias("src_bytes"),
            F.when(k % 11 == 0, "-").otherwise(s(k * 29)).alias("dst_bytes"),
            F.when(k % 7 == 0, "-").otherwise(s(k % 10)).alias("src_pkts"),
            F.when(k % 11 == 0, "-").otherwise(s(k % 12)).alias("dst_pkts"),
            (F.col("hot") & (F.col("event_type") == "error")).cast("int").alias("label"),
        )
    )


def flows_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large flow binding over lineitem (bench volume)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        epoch_seconds(li, "l_shipdate").alias("ts"),
        F.col("l_linenumber").alias("k"),
        F.when(F.col("l_linenumber") == 1, "-")
         .otherwise(F.col("l_quantity").cast("string")).alias("duration"),
        F.when(F.col("l_linenumber") == 2, "-")
         .otherwise(F.floor("l_extendedprice").cast("bigint").cast("string")).alias("src_bytes"),
        F.col("l_partkey").cast("string").alias("dst_bytes"),
        ((F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 97 == 0)).cast("int").alias("label"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metric-sample table: (metric, device, ts, seq, value)."""
    e = ev(spark, sf_dir).withColumn("device", (F.col("user_id") % 10).cast("int"))
    base = e.select("device", "ts", F.col("event_id").alias("seq"), "k")
    # Counter: running sum of k per device in event order (two-level, so a
    # device holding most events is still split across tasks).
    login = running_aggregate(
        base, keys=["device"], order=["seq"], value="k", out="_cum",
        bucket=F.floor(F.col("seq") / F.lit(4096)),
    )
    def sample(metric, value):
        return F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"))

    samples = F.array(
        sample("system_ram_usage_bytes", F.col("k") * F.lit(1e6)),
        sample("system_ram_total_bytes", F.lit(1e8)),
        sample("login_attempts_total", F.col("_cum") % 5000),
        sample("attack_type_code", F.col("k") % 3))
    return login.select("device", "ts", "seq", F.inline(samples)).select("metric", "device", "ts", "seq", "value")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor trace: (epoch, ip, temp)."""
    e = ev(spark, sf_dir)
    return e.where(F.col("event_type") == "view").select(
        F.floor("ts").cast("double").alias("epoch"),
        F.concat(F.lit("10.11.12."), (F.col("user_id") % 20).cast("string")).alias("ip"),
        F.col("value").alias("temp"),
        F.col("event_id").alias("seq"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet trace with times relative to the first sensor epoch."""
    e = ev(spark, sf_dir)
    t0 = ticks(spark, sf_dir).agg(F.min("epoch").alias("_t0"))
    k = F.col("k")
    return (
        e.where(F.col("event_type") != "view")
        .crossJoin(F.broadcast(t0))
        .select(
            F.col("event_id").alias("frame"),
            (F.col("ts") - F.col("_t0")).alias("rel"),
            F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("src"),
            F.concat(F.lit("10.1.0."), k.cast("string")).alias("dst"),
            F.when(F.col("event_type") == "error", "UDP")
             .when(F.col("event_type") == "click", "TCP").otherwise("MQTT").alias("proto"),
            F.when(k == 0, "bad").otherwise((k * 15).cast("string")).alias("size"),
            F.col("event_type").alias("info"),
        )
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scored sets (model a, model b) over the events."""
    e = ev(spark, sf_dir)
    lab = (F.col("event_type") == "error").cast("int")
    a = e.select(F.lit("a").alias("model"), F.col("event_id").alias("id"), lab.alias("label"),
                 (F.col("k") / F.lit(100.0)).alias("score"), (F.col("k") >= 50).cast("int").alias("pred"))
    b = e.select(F.lit("b").alias("model"), F.col("event_id").alias("id"), lab.alias("label"),
                 (F.col("value") / F.lit(500.0)).alias("score"),
                 (F.col("value") >= 100.0).cast("int").alias("pred"))
    return a.unionByName(b)


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_quantity").alias("cpu"),
        (F.lit(800.0) + F.col("l_tax") * 100).alias("ram"),
        (F.col("l_extendedprice") / 1000).alias("latency"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev(spark, sf_dir)
    body = F.concat(F.col("event_type"), F.lit(" k="), F.col("k").cast("string"))
    return e.select(
        F.concat(F.lit("log"), (F.col("user_id") % 5).cast("string")).alias("source"),
        F.col("event_id").alias("line"),
        F.when(F.col("k") % 2 == 0, F.upper(body)).otherwise(body).alias("text"),
    )


# ---------------------------------------------------------------------------
# DuckDB oracle text of the same bindings.
# ---------------------------------------------------------------------------

DUCK = {
    "ev": ([], """SELECT event_id, epoch_us(ts)/1e6 AS ts, user_id, event_type, value,
        cast(json_extract_string(props,'$.k') as int) AS k FROM events"""),
    "flows": (["ev"], """SELECT event_id, ts, concat('10.0.0.', cast(user_id as varchar)) AS src_ip,
        CASE event_type WHEN 'signup' THEN 'icmp' WHEN 'error' THEN 'udp' ELSE 'tcp' END AS proto,
        CASE WHEN NOT coalesce(hot OR k<50, false) THEN '0'
             WHEN event_type='signup' AND k%2=0 THEN '-' WHEN event_type='signup' THEN '0'
             ELSE cast(value as varchar) END AS duration,
        CASE WHEN k%7=0 THEN '-' ELSE cast(k*13 as varchar) END AS src_bytes,
        CASE WHEN k%11=0 THEN '-' ELSE cast(k*29 as varchar) END AS dst_bytes,
        CASE WHEN k%7=0 THEN '-' ELSE cast(k%10 as varchar) END AS src_pkts,
        CASE WHEN k%11=0 THEN '-' ELSE cast(k%12 as varchar) END AS dst_pkts,
        cast((hot AND event_type='error') as int) AS label
      FROM (SELECT *, ((cast(floor(ts/3600) as bigint) % 24) IN (2,3)) AS hot FROM ev) f"""),
    "flows_li": ([], """SELECT cast(epoch(l_shipdate) as double) AS ts, l_linenumber AS k,
        CASE WHEN l_linenumber=1 THEN '-' ELSE cast(l_quantity as varchar) END AS duration,
        CASE WHEN l_linenumber=2 THEN '-' ELSE cast(cast(floor(l_extendedprice) as bigint) as varchar) END AS src_bytes,
        cast(l_partkey as varchar) AS dst_bytes,
        cast((l_returnflag='R' AND l_orderkey%97=0) as int) AS label FROM lineitem"""),
    "metrics": (["ev"], """SELECT 'system_ram_usage_bytes' AS metric, cast(user_id%10 as int) AS device, ts, event_id AS seq, k*1e6 AS value FROM ev
      UNION ALL SELECT 'system_ram_total_bytes', cast(user_id%10 as int), ts, event_id, 1e8 FROM ev
      UNION ALL SELECT 'login_attempts_total', cast(user_id%10 as int), ts, event_id,
        cast(sum(k) OVER (PARTITION BY user_id%10 ORDER BY event_id) % 5000 as double) FROM ev
      UNION ALL SELECT 'attack_type_code', cast(user_id%10 as int), ts, event_id, cast(k%3 as double) FROM ev"""),
    "ticks": (["ev"], """SELECT floor(ts) AS epoch, concat('10.11.12.', cast(user_id%20 as varchar)) AS ip,
        value AS temp, event_id AS seq FROM ev WHERE event_type='view'"""),
    "packets": (["ev", "ticks"], """SELECT event_id AS frame, ts - (SELECT min(epoch) FROM ticks) AS rel,
        concat('10.0.0.', cast(user_id as varchar)) AS src, concat('10.1.0.', cast(k as varchar)) AS dst,
        CASE WHEN event_type='error' THEN 'UDP' WHEN event_type='click' THEN 'TCP' ELSE 'MQTT' END AS proto,
        CASE WHEN k=0 THEN 'bad' ELSE cast(k*15 as varchar) END AS size, event_type AS info
      FROM ev WHERE event_type<>'view'"""),
    "scored": (["ev"], """SELECT 'a' AS model, event_id AS id, cast(event_type='error' as int) AS label,
        k/100.0::DOUBLE AS score, cast(k>=50 as int) AS pred FROM ev
      UNION ALL SELECT 'b', event_id, cast(event_type='error' as int), value/500.0::DOUBLE,
        cast(value>=100.0::DOUBLE as int) FROM ev"""),
    "measurements": ([], """SELECT l_orderkey*10+l_linenumber AS sample, cast(l_returnflag='R' as int) AS label,
        l_quantity AS cpu, 800.0::DOUBLE + l_tax*100 AS ram, l_extendedprice/1000 AS latency FROM lineitem"""),
    "logs": (["ev"], """SELECT concat('log', cast(user_id%5 as varchar)) AS source, event_id AS line,
        CASE WHEN k%2=0 THEN upper(concat(event_type,' k=',cast(k as varchar)))
             ELSE concat(event_type,' k=',cast(k as varchar)) END AS text FROM ev"""),
}


def duck_with(bindings: list[str], *ctes: tuple[str, str], select: str) -> str:
    """Compose ``WITH <bindings + their deps>, <ctes> <select>`` for DuckDB."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in DUCK[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for b in bindings:
        visit(b)
    parts = [f"{n} AS ({DUCK[n][1]})" for n in order]
    parts += [f"{n} AS ({sql})" for n, sql in ctes]
    if not parts:
        return select
    return "WITH " + ",\n".join(parts) + "\n" + select
