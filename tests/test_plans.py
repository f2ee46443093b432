"""Plan-shape checks: the physical plans we rely on for scale."""

from pyspark.sql import functions as F

from flowsentry.operators.alignment import align_forward
from flowsentry.operators.cleaning import rebase
from flowsentry.operators.evaluation import roc_auc
from flowsentry.operators.windows import window_features
from flowsentry.plans.common import flows_clean
from flowsentry.sources import bindings as B

from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rebase_is_broadcast_scalar_not_global_window(spark):
    p = plan(rebase(B.flows(spark, SF_SMALL)))
    assert "Window" not in p
    assert "BroadcastNestedLoopJoin" in p or "BroadcastExchange" in p


def test_window_features_partial_aggregation(spark):
    p = plan(window_features(flows_clean(spark, SF_SMALL), 3600.0))
    assert p.count("HashAggregate") >= 2
    assert "partial_count" in p or "partial_" in p


def test_scan_pushdown_and_pruning(spark):
    p = plan(B.ticks(spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in p
    read = [ln for ln in p.splitlines() if "ReadSchema" in ln]
    assert read and all("props" not in ln for ln in read)


def test_alignment_scans_and_shuffles_packets_once(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("frame"), (F.col("id") * 0.37).alias("t")).write.parquet(f"{tmp_path}/pk")
    spark.range(50).select((F.col("id") * 7.0).alias("tick")).write.parquet(f"{tmp_path}/tk")
    pk, tk = spark.read.parquet(f"{tmp_path}/pk"), spark.read.parquet(f"{tmp_path}/tk")
    p = plan(align_forward(pk, tk, drop_tail=False, buckets=5))
    assert "CartesianProduct" not in p and "SortMergeJoin" not in p and "RangeJoin" not in p
    scans = [ln for ln in p.splitlines() if "FileScan" in ln]
    assert sum("/pk]" in ln or "frame" in ln for ln in scans) == 1
    # nested-loop joins broadcast the one-row quantile bounds, never rows of a trace
    loops = [ln for ln in p.splitlines() if "BroadcastNestedLoopJoin" in ln]
    assert len(loops) == 3 and all("Inner" in ln or "Cross" in ln for ln in loops)
    # rows are dealt once, by bucket and part
    assert sum("Exchange hashpartitioning(_qb" in ln and "_part" in ln for ln in p.splitlines()) == 1


def test_per_key_tables_are_broadcast_behind_a_size_check(spark):
    from flowsentry.operators.prefix import quantile_bucket, small_side
    df = spark.range(5000).select((F.col("id") % 2).alias("model"), F.rand(1).alias("score"))
    p = plan(quantile_bucket(df, ["model"], "score", 16))
    assert "BroadcastHashJoin" in p and "hashpartitioning(model" not in p
    small = spark.range(10).toDF("k")
    one = spark.range(10).toDF("k")
    assert "ResolvedHint (strategy=broadcast)" in one.join(small_side(small), "k")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in one.join(small_side(small, limit=5), "k")._jdf.queryExecution().analyzed().toString()


def test_auc_has_no_single_partition_exchange(spark):
    p = plan(roc_auc(B.scored(spark, SF_SMALL)))
    assert "SinglePartition" not in p


def test_running_aggregate_join_is_an_equi_join(spark):
    from flowsentry.operators.prefix import running_aggregate
    df = spark.range(10000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"),
                                   F.lit(1).alias("v"))
    p = plan(running_aggregate(df, ["k"], ["o"], "v", "cum", F.floor(F.col("o") / 100)))
    assert "<=>" not in p  # null-safe equality would shuffle the rows again
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
    assert "SortMergeJoin" in p or "BroadcastHashJoin" in p or "ShuffledHashJoin" in p
