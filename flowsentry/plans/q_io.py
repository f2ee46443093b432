"""Registered queries: flow and log scans, report sink, log analysis
(S1, S6, S7, P23, A18, O4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.operators import evaluation as EV
from flowsentry.operators import logs as LG
from flowsentry.plans.catalog import query
from flowsentry.plans.common import duck
from flowsentry.session import scratch_path
from flowsentry.sources import bindings as B
from flowsentry.sources.files import FLOW_RAW, read_csv_checked, read_flows, read_logs, write_report

REPORT_SCHEMA = ("model string, precision double, recall double, f1_score double, roc_auc double, "
                 "fpr double, fnr double, tp long, tn long, fp long, fn long")


@query("scan_flows", duck(["flows"], select="SELECT * FROM flows"), ["ts"])
def q_scan_flows(spark, sf):
    """Raw flow CSV (header) with a fixed all-text schema for dirty columns."""
    path = scratch_path(spark, "flows")
    write_report(B.flows(spark, sf), path, fmt="csv")
    return read_flows(spark, path)


_LINES = ("lines", "SELECT source, row_number() OVER (PARTITION BY source ORDER BY line) AS line, text FROM logs")


def _written_logs(spark, sf):
    """The log binding as text files, one folder per source, in line order."""
    path = scratch_path(spark, "logs")
    B.logs(spark, sf).repartition("source").sortWithinPartitions("source", "line").select("source", "text") \
        .write.partitionBy("source").text(path)
    return read_logs(spark, path)


@query("scan_logs", duck(["logs"], _LINES, select="SELECT * FROM lines"))
def q_scan_logs(spark, sf):
    """Text logs, one folder per source, read back with source and line number."""
    return _written_logs(spark, sf)


_REP = ("""SELECT model, precision, recall, f1_score, roc_auc, fpr, fnr, tp, tn, fp, fn FROM (
    SELECT model, tp, fp, fn, tn,
      CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0.0 END AS precision,
      CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0.0 END AS recall,
      CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0.0 END AS f1_score,
      CASE WHEN fp+tn > 0 THEN fp/(fp+tn) ELSE 0.0 END AS fpr,
      CASE WHEN fn+tp > 0 THEN fn/(fn+tp) ELSE 0.0 END AS fnr FROM (
      SELECT model, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp,
        count(*) FILTER (WHERE label <> 1 AND pred = 1) AS fp,
        count(*) FILTER (WHERE label = 1 AND pred <> 1) AS fn,
        count(*) FILTER (WHERE label <> 1 AND pred <> 1) AS tn FROM scored GROUP BY model) c) r
    JOIN (SELECT model, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
      THEN sum(pos * (coalesce(nb, 0) + 0.5 * neg)) / (cast(sum(pos) as double) * cast(sum(neg) as double)) END AS roc_auc
      FROM (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb
            FROM (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
                  FROM scored GROUP BY model, score) g) x GROUP BY model) a USING (model)""")


@query("report_roundtrip", duck(["scored"], select=_REP),
       ["precision", "recall", "f1_score", "roc_auc", "fpr", "fnr"])
def q_report_roundtrip(spark, sf):
    """Evaluation report written as CSV with header and read back."""
    path = scratch_path(spark, "report")
    write_report(EV.evaluation_report(B.scored(spark, sf)), path, fmt="csv")
    return spark.read.schema(REPORT_SCHEMA).option("header", True).csv(path)


@query("error_lines", duck(["logs"], select="""SELECT source, line, text FROM logs
    WHERE regexp_matches(text, '(?i)(error|failed)')"""))
def q_error_lines(spark, sf):
    """Case-insensitive error/failed lines."""
    return LG.error_lines(B.logs(spark, sf))


@query("error_counts", duck(["logs"], select="""SELECT source, count(*) AS n_errors FROM logs
    WHERE regexp_matches(text, '(?i)(error|failed)') GROUP BY source"""))
def q_error_counts(spark, sf):
    """Error lines per log source."""
    return LG.error_counts(B.logs(spark, sf))


@query("error_head", duck(["logs"], _LINES, select="""SELECT source, line, text, rn FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY line) AS rn FROM lines
    WHERE regexp_matches(text, '(?i)(error|failed)')) r WHERE rn <= 20"""))
def q_error_head(spark, sf):
    """First 20 matching lines per source of the log files (two-level top-k)."""
    return LG.error_head(_written_logs(spark, sf), 20)


# every 50th flow's line lacks its last fields, has two more, or an open quote
_BROKEN = "CASE event_id % 50 WHEN 7 THEN 'too few fields' WHEN 8 THEN 'too many fields' WHEN 9 THEN 'open quote' END"


@query("malformed_lines", duck(["flows"], ("b", f"SELECT event_id, {_BROKEN} AS reason FROM flows"),
        select="""SELECT coalesce(reason, 'good') AS kind, count(*) AS n, cast(sum(event_id) AS bigint) AS ids,
                  (SELECT count(*) FROM flows) AS n_lines FROM b GROUP BY 1"""))
def q_malformed_lines(spark, sf):
    """S1 + P19: flow lines as text, some broken; read with rejects.  The sum of
    event ids shows that each line landed once, with its own first field."""
    flows = B.flows(spark, sf)
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in flows.columns]
    whole = F.concat_ws(",", *fields)
    kind = F.expr(_BROKEN)
    line = F.when(kind == "too few fields", F.concat_ws(",", *fields[:-3])) \
        .when(kind == "too many fields", F.concat(whole, F.lit(",x,y"))) \
        .when(kind == "open quote", F.concat_ws(",", fields[0], F.concat(F.lit('"'), fields[1]), *fields[2:])).otherwise(whole)
    flows.select(line.alias("value")).write.text(path := scratch_path(spark, "malformed"))
    good, rejects = read_csv_checked(spark, path, FLOW_RAW)
    n = spark.read.text(path).agg(F.count(F.lit(1)).alias("n_lines"))
    both = good.select(F.lit("good").alias("kind"), "event_id").unionByName(
        rejects.select(F.col("reason").alias("kind"), F.split("line", ",")[0].cast("long").alias("event_id")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")).crossJoin(F.broadcast(n))
