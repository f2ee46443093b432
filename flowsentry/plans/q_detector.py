"""Registered queries: detectors as saved pipelines, the forest's least split
size, and pushed progress metrics (M1-M5, S8, S10, T1, T5)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from flowsentry.operators import stages as ST
from flowsentry.operators.forest import fit_forest
from flowsentry.plans.catalog import query
from flowsentry.plans.common import D_FC, D_SPLIT, D_WF, W, duck, train_test
from flowsentry.session import scratch_path
from flowsentry.sources import bindings as B
from flowsentry.streaming.committed import CommittedTable
from flowsentry.streaming.progress import LATE, LATENCY, ROWS, recorded
from flowsentry.streaming.runner import run_available_now, sliced
from flowsentry.streaming.windows import stream_windows

_ZT = ", ".join(
    f"(cast({c} as double) - (SELECT avg(cast({c} as double)) FROM tr)) / "
    f"coalesce(nullif((SELECT stddev_pop(cast({c} as double)) FROM tr), 0), 1.0) AS z_{c}"
    for c in ("flow_count", "avg_duration", "avg_bytes"))


@query("detector_roundtrip", duck(["flows"], D_FC, D_WF, *D_SPLIT, select=f"""SELECT m.detector, "window", label, {_ZT},
    true AS loaded_equals_fitted, true AS stream_equals_batch, true AS score_in_range, true AS pred_follows_score
    FROM te, (SELECT unnest(['isolation_forest', 'random_forest']) AS detector) m"""),
       ["z_flow_count", "z_avg_duration", "z_avg_bytes"])
def q_detector_roundtrip(spark, sf):
    """M1 + M3 + M5 + S10: scaler and detector fitted on the training windows as
    one pipeline, saved and loaded; the test windows scored by the fitted and the
    loaded pipeline and on a stream."""
    train, test = train_test(spark, sf)
    test = test.select("window", "label", "flow_count", "avg_duration", "avg_bytes")
    test.write.parquet(src := scratch_path(spark, "detector-windows"))
    out = None
    for kind in ("isolation_forest", "random_forest"):
        fitted = ST.detector_pipeline(kind).fit(train)
        fitted.write().overwrite().save(path := scratch_path(spark, f"detector-{kind}"))
        loaded = PipelineModel.load(path)
        cut = loaded.stages[-1].getOrDefault("cut") if kind == "isolation_forest" else 0.5
        stream = loaded.transform(spark.readStream.schema(test.schema).parquet(src)).select(
            "window", F.col("score").alias("stream_score"))
        streamed = run_available_now(spark, stream, f"detector-{kind}-stream")
        before = fitted.transform(test).select("window", F.col("score").alias("fitted_score"))
        both = loaded.transform(test).join(before, "window").join(streamed, "window").select(
            F.lit(kind).alias("detector"), "window", "label", *ST.Z_FEATURES,
            (F.col("score") == F.col("fitted_score")).alias("loaded_equals_fitted"),
            (F.col("score") == F.col("stream_score")).alias("stream_equals_batch"),
            F.col("score").between(0.0, 1.0).alias("score_in_range"),
            ((F.col("pred") == 1) == (F.col("score") > F.lit(float(cut)))).alias("pred_follows_score"))
        out = both if out is None else out.unionByName(both)
    return out


@query("forest_min_split", duck(["flows"], D_FC, D_WF, *D_SPLIT, select="""SELECT "window", label, 1.0::DOUBLE AS probability_sum,
    true AS pred_follows_score, true AS small_nodes_are_leaves, true AS children_add_up, 100 AS n_trees FROM te"""),
       ["probability_sum"])
def q_forest_min_split(spark, sf):
    """M2 + M3: forest whose nodes of fewer than five rows are leaves; the test
    windows scored with its node table, and the rules of the table."""
    train, test = train_test(spark, sf)
    grown = fit_forest(train)
    model = ST.ForestStageModel()
    model._set(inputCols=["flow_count", "avg_duration", "avg_bytes"])
    model.nodes = ST.collapse(ST.forest_nodes(grown))
    n = model.nodes
    kids = n.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(
        F.sum("n").alias("below"), F.count("*").alias("kids"))
    rules = n.join(kids, ["tree", "node"], "left").agg(
        F.bool_and((F.col("n") >= ST.MIN_SPLIT) | (F.col("feature") < 0)).alias("small_nodes_are_leaves"),
        F.bool_and(F.when(F.col("feature") < 0, F.col("below").isNull()).otherwise(
            (F.col("below") == F.col("n")) & (F.col("kids") == 2))).alias("children_add_up"),
        F.count_distinct("tree").cast("int").alias("n_trees"))
    turned = ST.ForestStageModel()  # the same trees, voting for the other class
    turned._set(inputCols=model.getInputCols(), scoreCol="other", predictionCol="other_pred")
    turned.nodes = n.withColumn("value", 1.0 - F.col("value"))
    return turned.transform(model.transform(test)).crossJoin(F.broadcast(rules)).select(
        "window", "label", (F.col("score") + F.col("other")).alias("probability_sum"),
        ((F.col("pred") == 1) == (F.col("score") > 0.5)).alias("pred_follows_score"),
        "small_nodes_are_leaves", "children_add_up", "n_trees")


PROGRESS_SLICES = 110
_SLICE = f"least({PROGRESS_SLICES - 1}, floor((ts - t0) * {PROGRESS_SLICES} / (t1 - t0)))"


@query("stream_progress", duck(["flows"],
        ("s", "SELECT *, min(ts) OVER () AS t0, max(ts) OVER () AS t1 FROM flows"),
        ("d", f"""SELECT ts - t0 AS et, {_SLICE} AS own, event_id % 89 = 0 AND {_SLICE} < 50 AS late,
                  CASE WHEN event_id % 89 = 0 AND {_SLICE} < 50 THEN 55 + event_id // 89 % 55 ELSE {_SLICE} END AS part FROM s"""),
        select=f"""SELECT '{LATE}' AS metric, cast(count(DISTINCT (part, floor(et / {W}))) AS double) AS total,
                     CAST(NULL AS BIGINT) AS batches FROM d WHERE late
                   UNION ALL SELECT '{ROWS}', count(*), NULL FROM d
                   UNION ALL SELECT '{LATENCY}', NULL, count(DISTINCT part) FROM d"""), ["total"])
def q_stream_progress(spark, sf):
    """T1 + T5: the window stream over 110 micro-batches, more than the progress
    reports that Spark keeps, its late rows, input rows and latencies recorded by
    a listener.  Late rows count once per window and batch."""
    raw = B.flows(spark, sf)
    ends = raw.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    own = F.least(F.lit(PROGRESS_SLICES - 1), F.floor(
        (F.col("ts") - F.col("t0")) * PROGRESS_SLICES / (F.col("t1") - F.col("t0"))).cast("int"))
    late = (F.col("event_id") % 89 == 0) & (F.col("own") < 50)
    d = sliced(spark, raw.crossJoin(F.broadcast(ends)).withColumn("own", own).withColumn("part", F.when(
        late, 55 + F.floor(F.col("event_id") / 89) % 55).otherwise(F.col("own"))).select(*raw.columns, "part"),
        "part", "progress-slices")
    t0 = float(ends.first()["t0"])
    src = scratch_path(spark, "progress-stream")
    for (i,) in sorted(d.select("part").distinct().collect()):  # at most 110 slices, one file each in this order
        d.where(F.col("part") == i).select(*raw.columns).coalesce(1).write.parquet(f"{src}/part={i:03d}")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/part=*")

    def start():
        return stream_windows(stream, t0, W, 0.0).writeStream.format("parquet").option("path", scratch_path(spark, "progress-out")) \
            .option("checkpointLocation", scratch_path(spark, "progress-ck")).outputMode("append").trigger(availableNow=True).start()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # two state partitions: the batches are small
    try:
        got = recorded(spark, scratch_path(spark, "progress-metrics"), start)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    timed = F.col("metric") == LATENCY
    return got.groupBy("metric").agg(F.sum(F.when(~timed, F.col("value"))).alias("total"),
                                     F.count(F.when(timed & (F.col("value") > 0), 1)).alias("batches")) \
        .select("metric", "total", F.when(timed, F.col("batches")).alias("batches"))


@query("committed_metrics", duck(["metrics"], select="""SELECT metric, count(*) AS n, cast(sum(seq) AS bigint) AS seqs,
    count(DISTINCT seq % 12) AS batches FROM metrics GROUP BY metric"""))
def q_committed_metrics(spark, sf):
    """S8 + T5: metric samples appended in twelve batches to a table with a
    commit log, some replayed, one left half-written, merged on the way."""
    m = B.metrics(spark, sf).select("metric", "device", "ts", "seq", "value", (F.col("seq") % 12).alias("batch"))
    m = sliced(spark, m, "batch", "committed-source")
    schema = "metric string, device int, ts double, seq long, value double"
    table = CommittedTable(spark, scratch_path(spark, "committed"), schema, merge_after=6)
    for batch in range(12):
        rows = m.where(F.col("batch") == batch).drop("batch")
        table.append(rows, "scrape", batch)
        if batch % 5 == 4:
            table.append(rows, "scrape", batch)
            rows.write.parquet(f"{table.path}/data/scrape-half-{batch}")
    return table.read().groupBy("metric").agg(
        F.count("*").alias("n"), F.sum("seq").alias("seqs"), F.count_distinct(F.col("seq") % 12).alias("batches"))
