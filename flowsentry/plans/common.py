"""Shared Spark sub-plans and DuckDB fragments of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.functions.scalar import NUMERIC_PATTERN
from flowsentry.operators.cleaning import clean_flows, rebase
from flowsentry.operators.splits import stratified_split
from flowsentry.operators.windows import window_features
from flowsentry.sources import bindings as B

W = B.FLOW_WINDOW_SECONDS


def flows_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebase(clean_flows(B.flows(spark, sf_dir)))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_features(flows_clean(spark, sf_dir), W)


def split_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with rank and split.

    The window table (one row per window, far smaller than the flows) is
    checkpointed before the split and the split after it: the split reads
    the windows twice and its result feeds several branches, and none of
    them should re-read the flow scan.
    """
    w = windows(spark, sf_dir).checkpoint(eager=True)
    return stratified_split(w, "label", "window", 0.3, 42).checkpoint(eager=True)


def train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = split_windows(spark, sf_dir)
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test")


# ----------------------------------------------------------------------------
# DuckDB fragments
# ----------------------------------------------------------------------------

def d_coerce(expr: str) -> str:
    v = f"try_cast(cast({expr} as varchar) AS DOUBLE)"
    return (f"(CASE WHEN regexp_full_match(cast({expr} as varchar), '{NUMERIC_PATTERN}') "
            f"AND NOT isinf({v}) THEN coalesce({v}, 0.0) ELSE 0.0 END)")


def d_clean(col: str) -> str:
    return d_coerce(f"replace({col}, '-', '0')")


D_FC = ("fc", f"""SELECT event_id, ts - (SELECT min(ts) FROM flows) AS ts, src_ip, proto,
    {d_coerce('duration')} AS duration, {d_clean('src_bytes')} AS src_bytes,
    {d_clean('dst_bytes')} AS dst_bytes, {d_clean('src_pkts')} AS src_pkts,
    {d_clean('dst_pkts')} AS dst_pkts, label FROM flows""")

D_WF = ("wf", f"""SELECT "window", flow_count, avg_duration, src_bytes, dst_bytes,
    (src_bytes + dst_bytes) / flow_count AS avg_bytes, label FROM (
      SELECT cast(floor(ts / {W}) as bigint) AS "window", count(duration) AS flow_count,
        avg(duration) AS avg_duration, sum(src_bytes) AS src_bytes, sum(dst_bytes) AS dst_bytes,
        max(label) AS label
      FROM fc WHERE duration > 0 GROUP BY 1) g""")

# Split: rank in md5 order per class; train quota by largest remainder.
D_SPLIT = [
    ("cc", """SELECT label, count(*) AS n_class FROM wf GROUP BY label"""),
    ("cq", """SELECT label, n_class, cast(fl + CASE WHEN r <= need THEN 1 ELSE 0 END as bigint) AS train_quota FROM (
        SELECT *, row_number() OVER (ORDER BY cont - fl DESC, label) AS r,
               n_train - sum(fl) OVER () AS need FROM (
          SELECT *, floor(cont) AS fl FROM (
            SELECT *, n_train * n_class / n AS cont FROM (
              SELECT *, n - ceil(0.3::DOUBLE * n) AS n_train FROM (
                SELECT label, n_class, sum(n_class) OVER () AS n FROM cc) a) b) c) d) e"""),
    ("sp", """SELECT wf.*, r.rank, CASE WHEN r.rank <= cq.train_quota THEN 'train' ELSE 'test' END AS split
      FROM wf JOIN (SELECT "window", row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', cast("window" as varchar))), "window") AS rank FROM wf) r
        USING ("window") JOIN cq USING (label)"""),
    ("tr", "SELECT * FROM sp WHERE split = 'train'"),
    ("te", "SELECT * FROM sp WHERE split = 'test'"),
]

D_THR = ("thr", """SELECT avg(cast(flow_count as double)) AS mean, stddev_samp(cast(flow_count as double)) AS std,
    avg(cast(flow_count as double)) + 2.0 * stddev_samp(cast(flow_count as double)) AS threshold
    FROM tr WHERE label = 0""")

D_THR_SCORED = ("ts_scored", """SELECT 'threshold' AS model, cast("window" as bigint) AS id, label,
    cast(flow_count as double) AS score, cast(flow_count > threshold as int) AS pred FROM te, thr""")


# Confusion rates and tie-aware AUC of scored rows
D_RATES = """SELECT {by}, tp, fp, fn, tn,
    CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0.0 END AS precision,
    CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0.0 END AS recall,
    CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0.0 END AS f1_score,
    CASE WHEN fp+tn > 0 THEN fp/(fp+tn) ELSE 0.0 END AS fpr,
    CASE WHEN fn+tp > 0 THEN fn/(fn+tp) ELSE 0.0 END AS fnr
  FROM (SELECT {by},
    count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp,
    count(*) FILTER (WHERE label <> 1 AND pred = 1) AS fp,
    count(*) FILTER (WHERE label = 1 AND pred <> 1) AS fn,
    count(*) FILTER (WHERE label <> 1 AND pred <> 1) AS tn
  FROM {src} GROUP BY {by}) c"""

D_AUC = """SELECT model, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
    THEN sum(pos * (coalesce(neg_below, 0) + 0.5 * neg)) / (cast(sum(pos) as double) * cast(sum(neg) as double))
    END AS roc_auc FROM (
      SELECT model, score, pos, neg,
        sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS neg_below
      FROM (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos,
                   count(*) FILTER (WHERE label <> 1) AS neg FROM {src} GROUP BY model, score) g) c
    GROUP BY model"""


def duck(bindings, *ctes, select):
    return B.duck_with(list(bindings), *ctes, select=select)
