"""Registered queries: measurement statistics and device profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.operators import stats as ST
from flowsentry.plans.catalog import query
from flowsentry.plans.common import duck
from flowsentry.session import scratch_path
from flowsentry.sources import bindings as B
from flowsentry.sources.files import read_device_stats

_BY = " UNION ALL ".join(
    f"""SELECT '{c}' AS metric,
      coalesce(avg({c}) FILTER (WHERE label = 0), 0.0) AS baseline_mean,
      coalesce(stddev_pop({c}) FILTER (WHERE label = 0), 0.0) AS baseline_std,
      count({c}) FILTER (WHERE label = 0) AS baseline_n,
      coalesce(avg({c}) FILTER (WHERE label = 1), 0.0) AS attack_mean,
      coalesce(stddev_pop({c}) FILTER (WHERE label = 1), 0.0) AS attack_std,
      count({c}) FILTER (WHERE label = 1) AS attack_n FROM measurements"""
    for c in ("cpu", "ram", "latency"))

_OV = " UNION ALL ".join(
    f"""SELECT '{c}' AS metric, avg({c}) AS mean, stddev_samp({c}) AS std, max({c}) AS max, min({c}) AS min
        FROM measurements""" for c in ("cpu", "ram", "latency"))

_DEV = ("dev", """SELECT sample, cpu AS cpu_pct, ram AS mem_mb, CASE WHEN label = 1 THEN 'attack' ELSE 'ok' END AS status
    FROM measurements""")


def _dev(spark, sf):
    m = B.measurements(spark, sf)
    return m.select("sample", F.col("cpu").alias("cpu_pct"), F.col("ram").alias("mem_mb"),
                    F.when(F.col("label") == 1, "attack").otherwise("ok").alias("status"))


@query("stats_by_class", duck(["measurements"], select=_BY),
       ["baseline_mean", "baseline_std", "attack_mean", "attack_std"])
def q_stats_by_class(spark, sf):
    """A10: per-class mean / population std / n of cpu, ram, latency."""
    return ST.stats_by_class(B.measurements(spark, sf))


@query("stats_overall", duck(["measurements"], select=_OV), ["mean", "std", "max", "min"])
def q_stats_overall(spark, sf):
    """Mean / sample std / max / min."""
    return ST.stats_overall(B.measurements(spark, sf))


@query("trimmed_latency", duck(["measurements"], ("cut", "SELECT quantile_cont(latency, 0.99) AS c FROM measurements"),
        select="""SELECT count(latency) AS n, round(avg(latency), 4) AS mean, round(stddev_pop(latency), 4) AS std,
                  round(quantile_cont(latency, 0.99), 4) AS p99 FROM measurements, cut WHERE latency <= c"""),
       ["mean", "std", "p99"])
def q_trimmed(spark, sf):
    """p99-trimmed latency statistics."""
    return ST.trimmed_stats(B.measurements(spark, sf), "latency", 0.99)


_SKETCH_PROBS = (0.01, 0.25, 0.5, 0.9, 0.99)


@query("latency_sketches", duck(["measurements"], select=f"""SELECT label, p, count(*) AS n, true AS within_error
    FROM measurements, (SELECT unnest({list(_SKETCH_PROBS)}::DOUBLE[]) AS p) x GROUP BY ALL"""), ["p"])
def q_latency_sketches(spark, sf):
    """Quantiles from stored daily sketches, merged per class; a merged
    quantile has about its share of the rows below it (ties: on either side)."""
    m = B.measurements(spark, sf).withColumn("ts", F.col("sample") * F.lit(3600.0))
    ST.daily_sketches(m, "latency", by=["label"]).write.parquet(path := scratch_path(spark, "latency-sketches"))
    q = ST.sketch_quantiles(spark.read.parquet(path), _SKETCH_PROBS, ["label"])
    long = q.select("label", "n", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"q{i}").alias("q"))
                                                      for i, p in enumerate(_SKETCH_PROBS)])).alias("x")).select("label", "n", "x.*")
    below = m.join(F.broadcast(long), "label").groupBy("label", "p", "n").agg(
        F.count_if(F.col("latency") < F.col("q")).alias("lo"), F.count_if(F.col("latency") <= F.col("q")).alias("hi"))
    err = F.col("n") * ST.SKETCH_ERROR + 1
    return below.select("label", "p", "n", ((F.col("lo") <= F.col("p") * F.col("n") + err)
                                            & (F.col("hi") >= F.col("p") * F.col("n") - err)).alias("within_error"))


def _bins(n):
    return duck(["measurements"],
        ("r", """SELECT CASE WHEN max(latency) > min(latency) THEN min(latency) ELSE min(latency) - 0.5 END AS lo,
                        CASE WHEN max(latency) > min(latency) THEN max(latency) ELSE max(latency) + 0.5 END AS hi
                 FROM measurements"""),
        ("c", f"""SELECT least(cast(floor((latency - lo) / (hi - lo) * {n}) as int), {n - 1}) AS bin, count(*) AS n
                 FROM measurements, r WHERE latency IS NOT NULL GROUP BY 1"""),
        ("bins", f"SELECT cast(range as int) AS bin FROM range({n})"),
        select=f"""SELECT bins.bin, r.lo + bins.bin * ((r.hi - r.lo) / {n}) AS lo,
                  r.lo + (bins.bin + 1) * ((r.hi - r.lo) / {n}) AS hi, cast(coalesce(c.n, 0) as bigint) AS n
                  FROM bins CROSS JOIN r LEFT JOIN c ON c.bin = bins.bin""")


@query("histogram", _bins(30), ["lo", "hi"])
def q_histogram(spark, sf):
    """30-bin equal-width latency histogram."""
    return ST.histogram(B.measurements(spark, sf), "latency", 30)


@query("histogram_40", _bins(40), ["lo", "hi"])
def q_histogram_40(spark, sf):
    """The device profile's 40 bins."""
    return ST.histogram(B.measurements(spark, sf), "latency", 40)


@query("scan_device_stats", duck(["measurements"], _DEV, select="SELECT * FROM dev"), ["cpu_pct", "mem_mb"])
def q_scan_dev(spark, sf):
    """Tab-separated device statistics, written and read back."""
    path = scratch_path(spark, "devstats")
    _dev(spark, sf).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    return read_device_stats(spark, path)


@query("device_profile", duck(["measurements"], _DEV, select="""SELECT count(*) AS n, avg(cpu_pct) AS cpu_mean,
    max(cpu_pct) AS cpu_max, avg(mem_mb) AS mem_mean, max(mem_mb) AS mem_max,
    100.0 * max(mem_mb) / 2048.0 AS mem_peak_pct FROM dev"""),
       ["cpu_mean", "cpu_max", "mem_mean", "mem_max", "mem_peak_pct"])
def q_device_profile(spark, sf):
    """Device CPU / memory profile against a 2048 MiB limit."""
    return ST.device_profile(_dev(spark, sf), 2048.0)
