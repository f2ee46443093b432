"""Registered queries: metric samples and metric queries (S5, S8, J2, W4-W8,
P12, P14, P15, P17, P21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.functions.scalar import verdict
from flowsentry.operators import metrics as M
from flowsentry.operators import windows as WN
from flowsentry.plans.catalog import query
from flowsentry.operators.baselines import sigma_detector
from flowsentry.plans.common import (
    D_FC, D_SPLIT, D_THR, D_THR_SCORED, D_WF, W, duck, flows_clean, train_test,
)
from flowsentry.session import scratch_path
from flowsentry.sources import bindings as B
from flowsentry.sources.files import read_metrics, write_report
from flowsentry.sources.scrape import SCHEMA as SCRAPED
from flowsentry.sources.scrape import scrape_stream

_AW = ("aw", f"""SELECT cast(floor(ts / {W}) as bigint) AS "window",
    cast(count(*) FILTER (WHERE duration > 0) as bigint) AS flow_count,
    coalesce(avg(duration) FILTER (WHERE duration > 0), 0.0) AS avg_duration,
    CASE WHEN count(*) FILTER (WHERE duration > 0) > 0
         THEN sum(src_bytes + dst_bytes) FILTER (WHERE duration > 0) / count(*) FILTER (WHERE duration > 0)
         ELSE 0.0 END AS avg_bytes,
    max(label) AS label FROM fc GROUP BY 1""")

_AT = ("at_", "SELECT (min(ts) + max(ts)) / 2 AS at FROM metrics")


def _at(m):
    return m.agg(((F.min("ts") + F.max("ts")) / 2).alias("at"))


@query("scan_metrics", duck(["metrics"], select="SELECT * FROM metrics"), ["ts", "value"])
def q_scan_metrics(spark, sf):
    """Metric samples written as parquet and read back with the fixed schema."""
    path = scratch_path(spark, "metrics")
    write_report(B.metrics(spark, sf), path, fmt="parquet")
    return read_metrics(spark, path)


@query("metric_samples", duck(["flows"], D_FC, _AW, select=f"""SELECT CASE feature
      WHEN 'flow_count' THEN 'iot_cyber_flow_count' WHEN 'avg_duration' THEN 'iot_cyber_avg_flow_duration_sec'
      WHEN 'avg_bytes' THEN 'iot_cyber_avg_flow_bytes' ELSE 'iot_cyber_attack_label' END AS metric,
    "window", ts, value FROM (UNPIVOT (SELECT "window", cast("window" * {W} as double) AS ts,
      cast(flow_count as double) AS flow_count, avg_duration, avg_bytes, cast(label as double) AS label FROM aw)
      ON flow_count, avg_duration, avg_bytes, label INTO NAME feature VALUE value) u"""), ["ts", "value"])
def q_metric_samples(spark, sf):
    """Agent windows published as gauge samples stamped at window start."""
    aw = WN.agent_windows(flows_clean(spark, sf), W)
    aw = aw.withColumn("ts", F.col("window") * F.lit(W))
    return M.to_metric_samples(aw, "ts", labels=["window"])


@query("static_labels", duck(["metrics"], select="""SELECT *, 'iot-universal-agent' AS job,
    'ubi-secure-node-01:8000' AS instance, 'residential-beta' AS device_group FROM metrics"""),
       ["ts", "value"])
def q_static_labels(spark, sf):
    """Scrape-target labels attached to every sample."""
    return M.with_labels(B.metrics(spark, sf))


@query("latest_metric", duck(["metrics"], _AT, select="""SELECT metric, device, value, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY metric, device ORDER BY ts DESC, seq DESC) AS rn
    FROM metrics, at_ WHERE ts <= at_.at AND value IS NOT NULL) r WHERE rn = 1"""), ["value", "ts"])
def q_latest(spark, sf):
    """Instant query at the middle of the sample range."""
    m = B.metrics(spark, sf)
    return M.latest(m, _at(m)).select("metric", "device", "value", "ts")


@query("latest_or_zero", duck(["metrics"], _AT,
        ("want", """SELECT unnest(['iot_cyber_flow_count', 'system_ram_usage_bytes', 'system_ram_total_bytes',
            'login_attempts_total', 'attack_type_code']) AS metric"""),
        ("lat", """SELECT metric, device, value FROM (
            SELECT *, row_number() OVER (PARTITION BY metric, device ORDER BY ts DESC, seq DESC) AS rn
            FROM metrics, at_ WHERE ts <= at_.at AND value IS NOT NULL) r WHERE rn = 1"""),
        select="""SELECT d.device, w.metric, coalesce(lat.value, 0.0) AS value
                  FROM (SELECT DISTINCT device FROM metrics) d CROSS JOIN want w
                  LEFT JOIN lat ON lat.metric = w.metric AND lat.device = d.device"""),
       ["value"])
def q_latest_or_zero(spark, sf):
    """Wanted metrics per device; a metric without samples reads 0.0."""
    m = B.metrics(spark, sf)
    wanted = ["iot_cyber_flow_count", "system_ram_usage_bytes", "system_ram_total_bytes",
              "login_attempts_total", "attack_type_code"]
    return M.latest_or_zero(m, _at(m), wanted)


@query("gauge_state", duck(["ticks"], select="""SELECT ip, temp FROM (
    SELECT *, row_number() OVER (PARTITION BY ip ORDER BY epoch DESC, seq DESC) AS rn FROM ticks) r
    WHERE rn = 1"""), ["temp"])
def q_gauge_state(spark, sf):
    """Last-write-wins temperature gauge per device ip."""
    return M.gauge_state(B.ticks(spark, sf), ["ip"], "temp", ["epoch", "seq"])


# steps of the whole series (no range in the lag), added to the later sample's range
_STEP = ("step", """SELECT *, CASE WHEN prev IS NULL THEN 0.0 WHEN value < prev THEN value ELSE value - prev END AS delta
    FROM (SELECT *, lag(value) OVER (PARTITION BY metric, device ORDER BY ts, seq) AS prev FROM metrics
          WHERE metric = 'login_attempts_total') a""")


def _logins(spark, sf):
    return B.metrics(spark, sf).where(F.col("metric") == "login_attempts_total")


@query("metric_increase", duck(["metrics"], _STEP, select="""SELECT metric, device, b * 60.0 AS range_start,
    sum(delta) AS increase FROM (SELECT *, cast(floor(ts / 60.0) as bigint) AS b FROM step) s
    GROUP BY metric, device, b"""), ["range_start", "increase"])
def q_increase(spark, sf):
    """Reset-aware counter increase per device and minute."""
    return M.counter_increase(_logins(spark, sf), 60.0)


@query("metric_rate", duck(["metrics"], _STEP, select="""SELECT metric, device, b * 3600.0 AS range_start,
    sum(delta) / 3600.0 AS rate FROM (SELECT *, cast(floor(ts / 3600.0) as bigint) AS b FROM step) s
    GROUP BY metric, device, b"""), ["range_start", "rate"])
def q_rate(spark, sf):
    """Per-second counter rate over aligned hours."""
    return M.counter_increase(_logins(spark, sf), 3600.0, per_second=True)


@query("metric_rate_sliding", duck(["metrics"], _STEP, select="""SELECT x.metric, x.device, x.ts, x.seq, x.value,
    sum(y.delta) / 3600.0 AS rate FROM step x JOIN step y ON x.device = y.device
      AND cast(round(y.ts * 1e6) as bigint) BETWEEN cast(round(x.ts * 1e6) as bigint) - 3600000000
                                                AND cast(round(x.ts * 1e6) as bigint)
    GROUP BY x.metric, x.device, x.ts, x.seq, x.value"""), ["ts", "value", "rate"])
def q_rate_sliding(spark, sf):
    """W6a, range form: rate over the hour before every sample."""
    return M.counter_sliding(_logins(spark, sf), 3600.0, per_second=True)


@query("resample_last", duck(["metrics"], select="""SELECT metric, device, (b + 1) * 5.0 AS ts, value FROM (
    SELECT *, row_number() OVER (PARTITION BY metric, device, b ORDER BY ts DESC, seq DESC) AS rn FROM (
      SELECT *, cast(floor(ts / 5.0) as bigint) AS b FROM metrics) a) r WHERE rn = 1"""), ["ts", "value"])
def q_resample(spark, sf):
    """5-second scrape resample, last value per tick."""
    return M.resample_last(B.metrics(spark, sf), 5.0)


@query("scrape_resample", duck(["metrics"], select="""SELECT metric, device, (b + 1) * 5.0 AS ts, value FROM (
    SELECT *, row_number() OVER (PARTITION BY metric, device, b ORDER BY ts DESC, seq DESC) AS rn FROM (
      SELECT *, cast(floor(ts / 5.0) as bigint) AS b FROM metrics) a) r WHERE rn = 1"""), ["ts", "value"])
def q_scrape_resample(spark, sf):
    """S5 + T4 + W7: samples scraped tick by tick as a stream, in batches of at
    most 100,000 five-second ticks, stopped and taken up again while files are
    added; the resampled stream equals the batch."""
    m = B.metrics(spark, sf).select("metric", F.col("device").cast("int").alias("device"), "ts",
                                    F.col("seq").cast("long").alias("seq"), F.col("value").cast("double").alias("value"))
    m = m.checkpoint(eager=True)
    middle = F.broadcast(m.agg(((F.min("ts") + F.max("ts")) / 2).alias("_mid")))
    src, out, ck = (scratch_path(spark, f"scrape-{x}") for x in ("files", "out", "ck"))
    for late in (False, True):
        half = m.crossJoin(middle).where((F.col("ts") >= F.col("_mid")) == F.lit(late)).drop("_mid")
        half.repartitionByRange(4, "ts").write.mode("append").parquet(src)
        stream = scrape_stream(spark, src, f"{ck}/ticks", max_ticks=100_000, closed=late)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return M.resample_last(spark.read.schema(SCRAPED).parquet(out), 5.0)


@query("lookback", duck(["metrics"], select="""SELECT * FROM metrics
    WHERE ts > (SELECT max(ts) FROM metrics) - 900.0"""), ["ts", "value"])
def q_lookback(spark, sf):
    """Samples of the last 15 minutes."""
    return M.lookback(B.metrics(spark, sf), 900.0)


_RAM = ("ram", """SELECT device, ts, seq, 100.0 * a / nullif(b, 0.0) AS pct FROM (
    SELECT device, ts, seq, max(value) FILTER (WHERE metric = 'system_ram_usage_bytes') AS a,
           max(value) FILTER (WHERE metric = 'system_ram_total_bytes') AS b
    FROM metrics WHERE metric IN ('system_ram_usage_bytes', 'system_ram_total_bytes')
    GROUP BY device, ts, seq) g WHERE a IS NOT NULL AND b IS NOT NULL""")


def _ram(spark, sf):
    return M.metric_ratio(B.metrics(spark, sf), "system_ram_usage_bytes", "system_ram_total_bytes",
                          ["device", "ts", "seq"])


@query("ram_percent", duck(["metrics"], _RAM, select="SELECT * FROM ram"), ["ts", "pct"])
def q_ram_percent(spark, sf):
    """Usage / total * 100 matched on (device, ts, seq)."""
    return _ram(spark, sf)


@query("threshold_bands", duck(["metrics"], _RAM, select="""SELECT device, ts, seq, pct,
    CASE WHEN pct IS NULL THEN NULL WHEN pct >= 80.0 THEN 'red' ELSE 'green' END AS band FROM ram"""),
       ["ts", "pct"])
def q_bands(spark, sf):
    """Absolute bands of the RAM gauge (red from 80 %)."""
    return _ram(spark, sf).withColumn("band", M.bands("pct", M.BANDS_PERCENT))


@query("value_mapping", duck(["metrics"], select="""SELECT device, ts, seq, value,
    CASE cast(value as int) WHEN 0 THEN 'Benign' WHEN 1 THEN 'Mirai/DDoS' WHEN 2 THEN 'BruteForce'
      ELSE cast(cast(value as int) as varchar) END AS attack_type,
    CASE WHEN value >= 1.0 THEN 'red' ELSE 'green' END AS band
    FROM metrics WHERE metric = 'attack_type_code'"""), ["ts", "value"])
def q_value_mapping(spark, sf):
    """P14 + P15: attack-type code to text, with its stat-panel band."""
    m = B.metrics(spark, sf).where(F.col("metric") == "attack_type_code")
    return m.select("device", "ts", "seq", "value", M.attack_type_text("value").alias("attack_type"),
                    M.bands("value", M.BANDS_ATTACK).alias("band"))


@query("verdict", duck(["flows"], D_FC, D_WF, *D_SPLIT, D_THR, D_THR_SCORED, select="""SELECT id, pred,
    CASE WHEN pred = 1 THEN 'THREAT DETECTED' ELSE 'NORMAL' END AS verdict FROM ts_scored"""))
def q_verdict(spark, sf):
    """Status text of the threshold detector's predictions on the test windows."""
    train, test = train_test(spark, sf)
    p = sigma_detector(train, test, 2.0)
    return p.select("id", "pred", verdict("pred").alias("verdict"))


_CO2 = """CASE WHEN k * 30.0 >= 2000.0 THEN 'red' WHEN k * 30.0 >= 1000.0 THEN '#EAB839' ELSE 'green' END"""


@query("co2_bands", duck(["ev"], select=f"""SELECT event_id, k * 30.0 AS co2, {_CO2} AS band,
    'green' AS single FROM ev"""), ["co2"])
def q_co2_bands(spark, sf):
    """The three CO2 bands (1000 and 2000 ppm) and a panel with one step."""
    e = B.ev(spark, sf).select("event_id", (F.col("k") * F.lit(30.0)).alias("co2"))
    return e.withColumn("band", M.bands("co2", M.BANDS_CO2)).withColumn("single", M.bands("co2", M.BANDS_CO2[:1]))
