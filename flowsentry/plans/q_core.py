"""Registered queries: cleaning, windows, split, counts (S12, P1-P10, P13,
A1-A3, A17, A19, A21, W1-W3, J4, O1)."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from flowsentry.functions.scalar import window_id
from flowsentry.operators import cleaning as C
from flowsentry.operators import splits as S
from flowsentry.operators import stats as ST
from flowsentry.operators import windows as WN
from flowsentry.plans.catalog import query
from flowsentry.plans.common import (
    D_FC, D_SPLIT, D_WF, W, d_clean, d_coerce, duck, flows_clean, split_windows, windows,
)
from flowsentry.session import scratch_path
from flowsentry.sources import bindings as B

_FC_DOUBLES = ["ts", "duration", "src_bytes", "dst_bytes", "src_pkts", "dst_pkts"]
_WF_DOUBLES = ["avg_duration", "src_bytes", "dst_bytes", "avg_bytes"]


@query("clean_flows", duck(["flows"], D_FC, select="SELECT * FROM fc"), _FC_DOUBLES)
def q_clean_flows(spark, sf):
    """Sentinel-cleaned, coerced, rebased flows."""
    return flows_clean(spark, sf)


@query("rebase_ts", duck(["flows"], select="""SELECT event_id, ts - (SELECT min(ts) FROM flows) AS ts,
    ts AS raw_ts FROM flows"""), ["ts", "raw_ts"])
def q_rebase(spark, sf):
    f = B.flows(spark, sf).select("event_id", "ts", F.col("ts").alias("raw_ts"))
    return C.rebase(f, "ts")


@query("valid_flows", duck(["flows"], D_FC, select="SELECT * FROM fc WHERE duration > 0"), _FC_DOUBLES)
def q_valid(spark, sf):
    return C.valid_flows(flows_clean(spark, sf))


@query("window_id", duck(["flows"], D_FC, select=f"""SELECT event_id, ts,
    cast(floor(ts / {W}) as bigint) AS "window" FROM fc"""), ["ts"])
def q_window_id(spark, sf):
    return WN.with_window(flows_clean(spark, sf).select("event_id", "ts"), W)


@query("window_features", duck(["flows"], D_FC, D_WF, select="SELECT * FROM wf"), _WF_DOUBLES)
def q_window_features(spark, sf):
    """A1 (flagship): clean -> rebase -> valid -> 1 h windows."""
    return windows(spark, sf)


@query("sorted_windows", duck(["flows"], D_FC, D_WF, select='SELECT * FROM wf ORDER BY "window"'),
       _WF_DOUBLES)
def q_sorted_windows(spark, sf):
    return windows(spark, sf).orderBy("window")


@query("agent_windows", duck(["flows"], D_FC, select=f"""SELECT cast(floor(ts / {W}) as bigint) AS "window",
    cast(count(*) FILTER (WHERE duration > 0) as bigint) AS flow_count,
    coalesce(avg(duration) FILTER (WHERE duration > 0), 0.0) AS avg_duration,
    CASE WHEN count(*) FILTER (WHERE duration > 0) > 0
         THEN sum(src_bytes + dst_bytes) FILTER (WHERE duration > 0) / count(*) FILTER (WHERE duration > 0)
         ELSE 0.0 END AS avg_bytes,
    max(label) AS label FROM fc GROUP BY 1"""), ["avg_duration", "avg_bytes"])
def q_agent_windows(spark, sf):
    """A2: zero-filled windows, label over all flows."""
    return WN.agent_windows(flows_clean(spark, sf), W)


@query("class_balance", duck(["flows"], D_FC, D_WF, select="SELECT label, count(*) AS n FROM wf GROUP BY label"))
def q_class_balance(spark, sf):
    return WN.class_balance(windows(spark, sf))


@query("flow_counts", duck(["flows"], D_FC, select="""SELECT count(*) AS n_flows,
    count(*) FILTER (WHERE duration > 0) AS n_valid FROM fc"""))
def q_flow_counts(spark, sf):
    return C.flow_counts(flows_clean(spark, sf))


# every 97th flow reads 1e999 (an overflow), every 101st NaN, every 103rd 60d
_ODD = """CASE WHEN event_id % 97 = 0 THEN '1e999' WHEN event_id % 101 = 0 THEN 'NaN'
    WHEN event_id % 103 = 0 THEN '60d' ELSE duration END"""


@query("quality_gate", duck(["flows"], ("odd", f"SELECT label, {_ODD} AS d FROM flows"),
        ("gate", f"""SELECT label, {d_coerce('d')} AS duration, d = '1e999' AS inf FROM odd"""),
        select="""SELECT '' AS missing_columns, count(*) AS n_rows,
    count(*) FILTER (WHERE duration > 0) AS n_valid,
    count(*) FILTER (WHERE duration > 0 AND label = 1) AS n_attack, count(*) FILTER (WHERE inf) AS n_infinite,
    count(*) FILTER (WHERE duration > 0) > 0 AS ok,
    count(*) FILTER (WHERE duration > 0 AND label = 1) > 0 AS attack_ok FROM gate"""))
def q_quality_gate(spark, sf):
    """Gates over flows that hold overflowing and non-numeric durations."""
    raw = B.flows(spark, sf).withColumn("duration", F.expr(_ODD))
    return C.quality_gate(C.clean_flows(raw), raw=raw)


@query("gate_inside_scan", duck(["flows"], ("odd", f"SELECT label, {_ODD} AS d FROM flows"),
        ("gate", f"""SELECT label, {d_coerce('d')} AS duration, d = '1e999' AS inf FROM odd"""),
        select="""SELECT '' AS missing_columns, count(*) AS n_rows,
    count(*) FILTER (WHERE duration > 0) AS n_valid,
    count(*) FILTER (WHERE duration > 0 AND label = 1) AS n_attack, count(*) FILTER (WHERE inf) AS n_infinite,
    count(*) FILTER (WHERE duration > 0) > 0 AS ok,
    count(*) FILTER (WHERE duration > 0 AND label = 1) > 0 AS attack_ok FROM gate"""))
def q_gate_inside_scan(spark, sf):
    """S12 + A1: the same gates, counted by the scan that builds the windows."""
    own, seen = spark.newSession(), Observation()  # see ``gated_flows``
    flows = C.gated_flows(B.flows(own, sf).withColumn("duration", F.expr(_ODD)), watch=seen)
    WN.window_features(flows, W).write.parquet(scratch_path(spark, "gated-windows"))
    return C.gate_row(spark, seen.get)


@query("dropna_windows", duck(["flows"], D_FC, D_WF, select="""SELECT * FROM wf WHERE "window" IS NOT NULL
    AND flow_count IS NOT NULL AND avg_duration IS NOT NULL AND src_bytes IS NOT NULL
    AND dst_bytes IS NOT NULL AND avg_bytes IS NOT NULL AND label IS NOT NULL"""), _WF_DOUBLES)
def q_dropna(spark, sf):
    return C.dropna(windows(spark, sf))


@query("benign_windows", duck(["flows"], D_FC, D_WF, select="SELECT * FROM wf WHERE label = 0"), _WF_DOUBLES)
def q_benign(spark, sf):
    return C.by_label(windows(spark, sf), 0)


@query("from_window", duck(["flows"], D_FC, D_WF, select='SELECT * FROM wf WHERE "window" >= 100'), _WF_DOUBLES)
def q_from_window(spark, sf):
    return WN.from_window(windows(spark, sf), 100)


@query("warmup_time", duck(["flows"], D_FC, D_WF, select="""SELECT *, ("window" < 6 AND label = 0) AS warmup
    FROM wf"""), _WF_DOUBLES)
def q_warmup_time(spark, sf):
    """P10: both halves of the time warm-up split, tagged."""
    warm, rest = S.warmup_time(windows(spark, sf), 6)
    return warm.withColumn("warmup", F.lit(True)).unionByName(rest.withColumn("warmup", F.lit(False)))


@query("nonzero_windows", duck(["flows"], D_FC, select=f"""SELECT * FROM (
    SELECT cast(floor(ts / {W}) as bigint) AS "window",
      cast(count(*) FILTER (WHERE duration > 0) as bigint) AS flow_count,
      coalesce(avg(duration) FILTER (WHERE duration > 0), 0.0) AS avg_duration,
      CASE WHEN count(*) FILTER (WHERE duration > 0) > 0
           THEN sum(src_bytes + dst_bytes) FILTER (WHERE duration > 0) / count(*) FILTER (WHERE duration > 0)
           ELSE 0.0 END AS avg_bytes,
      max(label) AS label FROM fc GROUP BY 1) a
    WHERE NOT (flow_count = 0 AND avg_duration = 0 AND avg_bytes = 0)"""), ["avg_duration", "avg_bytes"])
def q_nonzero(spark, sf):
    """Agent windows that would be scored (not all-zero)."""
    return C.nonzero(WN.agent_windows(flows_clean(spark, sf), W))


@query("window_ids", duck(["flows"], D_FC, select=f"""SELECT DISTINCT cast(floor(ts / {W}) as bigint) AS "window" FROM fc"""))
def q_window_ids(spark, sf):
    return WN.window_ids(WN.with_window(flows_clean(spark, sf), W))


@query("stratified_split", duck(["flows"], D_FC, D_WF, *D_SPLIT,
                                select='SELECT "window", label, rank, split FROM sp'))
def q_split(spark, sf):
    """Exact-size stratified 70/30 split in digest order."""
    return split_windows(spark, sf).select("window", "label", "rank", "split")


@query("kfold_ids", duck(["flows"], D_FC, D_WF, select="""SELECT "window", label,
    cast((row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', cast("window" as varchar))), "window") - 1) % 5 as int) AS fold
    FROM wf"""))
def q_kfold(spark, sf):
    return S.kfold(windows(spark, sf), "label", "window", 5, 42).select("window", "label", "fold")


@query("warmup_fraction", duck(["flows"], D_FC, D_WF, *D_SPLIT, select="""SELECT "window", label, rank FROM tr
    WHERE label = 0 AND rank <= (SELECT greatest(1, floor(0.1::DOUBLE * count(*))) FROM tr WHERE label = 0)"""))
def q_warmup_fraction(spark, sf):
    return S.warmup_fraction(split_windows(spark, sf), 0.1).select("window", "label", "rank")


@query("split_overlap", duck(["flows"], D_FC, D_WF, *D_SPLIT, select="""SELECT count(*) AS n_overlap FROM (
    SELECT "window" FROM tr INTERSECT SELECT "window" FROM te) x"""))
def q_split_overlap(spark, sf):
    """Train and test share no window."""
    s = split_windows(spark, sf)
    return S.overlap(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"))


@query("split_overlap_found", duck(["flows"], D_FC, D_WF, *D_SPLIT, select="""SELECT count(*) AS n_overlap FROM (
    SELECT "window" FROM tr INTERSECT SELECT "window" FROM wf WHERE "window" % 3 = 0) x"""))
def q_split_overlap_found(spark, sf):
    """A leak is found: the training windows against every third window."""
    s = split_windows(spark, sf)
    return S.overlap(s.where(F.col("split") == "train"), s.where(F.col("window") % 3 == 0))


_HOLES = """SELECT "window", CASE WHEN "window" % 7 = 0 THEN NULL ELSE flow_count END AS flow_count,
    CASE WHEN "window" % 11 = 0 THEN NULL ELSE avg_duration END AS avg_duration, avg_bytes,
    CASE WHEN "window" % 13 = 0 THEN NULL ELSE label END AS label FROM wf"""


@query("dropna_holes", duck(["flows"], D_FC, D_WF, ("h", _HOLES), select="""SELECT * FROM h
    WHERE flow_count IS NOT NULL AND avg_duration IS NOT NULL AND label IS NOT NULL"""), ["avg_duration", "avg_bytes"])
def q_dropna_holes(spark, sf):
    """Windows with null features or labels go."""
    holes = lambda c, n: F.when(F.col("window") % n != 0, F.col(c)).alias(c)
    return C.dropna(windows(spark, sf).select("window", holes("flow_count", 7), holes("avg_duration", 11), "avg_bytes",
                                              holes("label", 13)))


@query("time_to_first_attack", duck(["flows"], D_FC, select="""SELECT
    min(ts) FILTER (WHERE label = 1) - 60.0 AS time_to_first_attack FROM fc"""), ["time_to_first_attack"])
def q_ttfa(spark, sf):
    """First attack time after a 60 s warm-up; NULL when no attack."""
    return ST.time_to_first_attack(flows_clean(spark, sf), 60.0)


_LI = B.FLOWS_LI_WINDOW_SECONDS
_D_FC_LI = ("fcl", f"""SELECT ts - (SELECT min(ts) FROM flows_li) AS ts, k,
    {d_coerce('duration')} AS duration, {d_clean('src_bytes')} AS src_bytes,
    {d_clean('dst_bytes')} AS dst_bytes,
    label FROM flows_li""")


@query("window_features_li", duck(["flows_li"], _D_FC_LI, select=f"""SELECT "window", flow_count, avg_duration,
    src_bytes, dst_bytes, (src_bytes + dst_bytes) / flow_count AS avg_bytes, label FROM (
      SELECT cast(floor(ts / {_LI}) as bigint) AS "window", count(duration) AS flow_count,
        avg(duration) AS avg_duration, sum(src_bytes) AS src_bytes, sum(dst_bytes) AS dst_bytes, max(label) AS label
      FROM fcl WHERE duration > 0 GROUP BY 1) g"""), _WF_DOUBLES)
def q_window_features_li(spark, sf):
    """A1 at bench volume: every lineitem row is a flow, one-day windows."""
    return WN.window_features(C.rebase(C.clean_flows(B.flows_li(spark, sf))), _LI)
