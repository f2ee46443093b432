"""Connected components of an edge table, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.session import checkpoint_dir


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(id, component_id)`` for every id in an edge table ``(a, b)``:
    the smallest id reachable by edges.

    Large-star / small-star: every round hangs the larger neighbours of an
    id onto the smallest id it knows, until the edges form stars.  Each step
    is one hash aggregate for the minimum and one join back, so a node that
    holds a third of all edges is pre-aggregated and its join split by AQE.
    Lineage is cut with ``checkpoint()`` in each round.  No edges: no rows.
    Ends after O(log n) rounds in practice; more than ``max_rounds`` raises.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")) \
        .where("u <> v").distinct().checkpoint(eager=True)
    before = None
    for _ in range(max_rounds):
        # large star: both directions, every larger neighbour to the minimum
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        # small star: smaller neighbours and the node itself to the minimum
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e2 = small.select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct() \
            .checkpoint(eager=True)
        state = e2.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e, done, before = e2, tuple(state) == before, tuple(state)
        if done:
            roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
            return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")
