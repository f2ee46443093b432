import pytest
from pyspark.sql import functions as F

from flowsentry.functions.scalar import band, clean_numeric, coerce_zero, map_values, verdict

SENTINELS = [("-", 0.0), ("12", 12.0), ("-5", 5.0), ("1-2", 102.0), (None, 0.0), ("abc", 0.0),
             ("1e3", 1000.0), (" 7 ", 7.0), ("0x1", 0.0), ("NaN", 0.0), ("1.0d", 0.0),
             ("2f", 0.0), ("inf", 0.0), ("+3", 3.0), (".5", 0.5), ("", 0.0), ("1e-3", 1000.0)]


def test_sentinel_clean_is_textual(spark):
    df = spark.createDataFrame([(v,) for v, _ in SENTINELS], "v string")
    got = [r[0] for r in df.select(clean_numeric("v")).collect()]
    assert got == [e for _, e in SENTINELS]


def test_strict_sentinel_only_whole_dash(spark):
    df = spark.createDataFrame([("-",), ("-5",), ("1-2",)], "v string")
    got = [r[0] for r in df.select(clean_numeric("v", strict=True)).collect()]
    assert got == [0.0, -5.0, 0.0]


def test_coerce_zero_keeps_sign(spark):
    df = spark.createDataFrame([("-",), ("-5",), ("3.5",), ("x",)], "v string")
    assert [r[0] for r in df.select(coerce_zero("v")).collect()] == [0.0, -5.0, 3.5, 0.0]


def test_bands_and_mapping(spark):
    df = spark.createDataFrame([(0.0,), (999.0,), (1000.0,), (2500.0,), (None,)], "v double")
    steps = [(None, "green"), (1000.0, "amber"), (2000.0, "red")]
    assert [r[0] for r in df.select(band("v", steps)).collect()] == ["green", "green", "amber", "red", None]
    m = spark.createDataFrame([(0,), (1,), (2,), (7,)], "c int")
    got = [r[0] for r in m.select(map_values("c", {0: "Benign", 1: "Mirai/DDoS", 2: "BruteForce"})).collect()]
    assert got == ["Benign", "Mirai/DDoS", "BruteForce", "7"]
    v = spark.createDataFrame([(1,), (0,)], "p int")
    assert [r[0] for r in v.select(verdict("p")).collect()] == ["THREAT DETECTED", "NORMAL"]


def test_epoch_seconds_ignores_session_zone(spark):
    import datetime as dt
    from flowsentry.functions.scalar import epoch_seconds
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 7, 179575),), (dt.datetime(2024, 7, 1),)],
                               "ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/New_York", "Asia/Kolkata", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", tz)  # incl. daylight-saving zones
            got = [r[0] for r in df.select(epoch_seconds(df, "ts")).collect()]
            assert got == [1704067207.179575, 1719792000.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def _py_clean(s, replace):
    """Reference semantics: optional textual '-' -> '0', then a plain decimal
    parse; anything unparseable is 0."""
    if s is None:
        return 0.0
    t = s.replace("-", "0") if replace else s
    try:
        v = float(t)
    except ValueError:
        return 0.0
    return 0.0 if v != v or v in (float("inf"), float("-inf")) else v


def test_clean_numeric_property(spark):
    from hypothesis import given, settings, strategies as st
    alphabet = st.sampled_from(list("0123456789-+.e "))

    @settings(max_examples=3, deadline=None)
    @given(st.lists(st.text(alphabet, max_size=7), min_size=50, max_size=200))
    def check(values):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        got = df.select(clean_numeric("v").alias("c"), coerce_zero("v").alias("z")).collect()
        for v, r in zip(values, got):
            assert r.c == _py_clean(v, True), (v, r.c)
            assert r.z == _py_clean(v, False), (v, r.z)

    check()


def test_percent_nonzero_labels(spark):
    from flowsentry.functions.scalar import percent
    from flowsentry.operators.cleaning import nonzero
    from flowsentry.operators.metrics import AGENT_TARGET_LABELS, with_labels
    df = spark.createDataFrame([(50.0, 200.0), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(percent("a", "b")).collect()] == [25.0, None]
    w = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0), (0, 0.0, 2.0)],
                              "flow_count long, avg_duration double, avg_bytes double")
    assert nonzero(w).count() == 2
    r = with_labels(df).first().asDict()
    assert all(r[k] == v for k, v in AGENT_TARGET_LABELS.items())
