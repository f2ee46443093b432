import ast

from pyspark.sql import functions as F

from flowsentry.operators.metrics import resample_last
from flowsentry.session import scratch_path
from flowsentry.sources.scrape import SCHEMA, scrape_stream


def samples(spark, *times):
    return spark.createDataFrame([("m", i % 3, float(t), i, float(i)) for i, t in enumerate(times)], SCHEMA)


def run(spark, src, out, ck, max_ticks, batches=None, closed=True):
    """Runs the query until it has caught up, or for some batches."""
    stream = scrape_stream(spark, src, f"{ck}/ticks", max_ticks=max_ticks, closed=closed)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).start()
    try:
        if batches is None:
            q.processAllAvailable()
        else:
            import time
            end = time.time() + 60
            while time.time() < end and sum(p.numInputRows > 0 for p in q.recentProgress) < batches:
                time.sleep(0.05)
        tick = lambda x: ast.literal_eval(str(x))["tick"] if "tick" in str(x) else None
        return [(tick(p.sources[0].startOffset), tick(p.sources[0].endOffset)) for p in q.recentProgress if p.numInputRows]
    finally:
        q.stop()


def test_restart_has_no_gap_and_no_duplicate(spark):
    src, out, ck = (scratch_path(spark, f"t-scrape-{x}") for x in ("in", "out", "ck"))
    times = [1000 + i * 0.7 for i in range(400)] + [1000.0, 1004.999, 1005.0, 5000.0]
    df = samples(spark, *times).repartitionByRange(3, "ts")
    df.write.parquet(src)
    first = run(spark, src, out, ck, 9, batches=2)
    assert len(first) >= 2 and all(b - a <= 9 for a, b in first if a is not None)
    rest = run(spark, src, out, ck, 4)
    got = spark.read.schema(SCHEMA).parquet(out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert max(b for _, b in rest) == 1001
    # samples that come later than the query is, and only whole ticks while the files are open
    samples(spark, 6000.0, 6001.0, 6007.0).withColumn("seq", F.col("seq") + 900).write.mode("append").parquet(src)
    run(spark, src, out, ck, 1000, closed=False)
    assert sorted(r.ts for r in spark.read.schema(SCHEMA).parquet(out).where("seq >= 900").collect()) == [6000.0, 6001.0]
    run(spark, src, out, ck, 1000)
    both = spark.read.parquet(src)
    assert spark.read.schema(SCHEMA).parquet(out).exceptAll(both.select(*[c.split()[0] for c in SCHEMA.split(", ")])).count() == 0
    assert spark.read.schema(SCHEMA).parquet(out).count() == both.count()
    a = resample_last(spark.read.schema(SCHEMA).parquet(out), 5.0).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, resample_last(both, 5.0).collect()))


def test_empty_folder(spark):
    src, out, ck = (scratch_path(spark, f"t-scrape0-{x}") for x in ("in", "out", "ck"))
    samples(spark, 1.0).limit(0).write.parquet(src)
    assert run(spark, src, out, ck, 5) == []
