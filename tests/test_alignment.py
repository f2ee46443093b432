import numpy as np
import pandas as pd

from flowsentry.operators.alignment import align_forward, packets_per_tick, protocol_running
from flowsentry.operators.inject import inject_flood, inject_sensor


def _ticks(spark, ts):
    return spark.createDataFrame([(float(t),) for t in ts], "tick double")


def test_forward_edge_case(spark):
    p = spark.createDataFrame([(1, 0.2), (2, 1.0), (3, 1.5), (4, 3.2), (5, 2.5)], "frame long, t double")
    full = {r.frame: r.tick for r in align_forward(p, _ticks(spark, [1, 2, 3]), drop_tail=False, buckets=3).collect()}
    assert full == {1: 1.0, 2: 1.0, 3: 2.0, 5: 3.0}
    tail = {r.frame: r.tick for r in align_forward(p, _ticks(spark, [1, 2, 3]), drop_tail=True, buckets=3).collect()}
    assert tail == {1: 1.0, 2: 1.0, 3: 2.0}
    per = {r.tick: r.n_packets for r in packets_per_tick(align_forward(p, _ticks(spark, [1, 2, 3]), buckets=3),
                                                          _ticks(spark, [1, 2, 3])).collect()}
    assert per == {1.0: 2, 2.0: 1}


def test_matches_merge_asof_with_gaps(spark):
    rng = np.random.default_rng(7)
    ticks = np.unique(np.r_[rng.uniform(0, 100, 40), rng.uniform(500, 520, 10)].round(2))
    pk = pd.DataFrame({"frame": np.arange(3000), "t": rng.uniform(-5, 530, 3000).round(3)})
    got = align_forward(spark.createDataFrame(pk), _ticks(spark, ticks), drop_tail=False,
                        buckets=16).toPandas().set_index("frame").tick
    exp = pd.merge_asof(pk.sort_values("t"), pd.DataFrame({"tick": ticks, "k": ticks}),
                        left_on="t", right_on="k", direction="forward").dropna().set_index("frame").tick
    assert got.sort_index().equals(exp.sort_index())


def test_hot_timestamp_is_spread(spark):
    """A third of all packets at one time: right ticks, many parts."""
    rows = [(i, 5.5 if i % 3 == 0 else i * 0.01) for i in range(3000)]
    p = spark.createDataFrame(rows, "frame long, t double")
    out = align_forward(p, _ticks(spark, [1, 6, 20, 40]), drop_tail=False, buckets=2, spread=16)
    want = {i: min((k for k in (1.0, 6.0, 20.0, 40.0) if k >= t), default=None) for i, t in rows}
    assert {r.frame: r.tick for r in out.collect()} == {i: t for i, t in want.items() if t is not None}
    assert align_forward(p, _ticks(spark, [1]).limit(0)).count() == 0


def test_running_protocol_counter(spark):
    p = spark.createDataFrame([(i, float(i), "UDP" if i % 3 else "TCP") for i in range(50)],
                              "frame long, t double, proto string")
    r = protocol_running(p, bucket_s=7.0).toPandas().sort_values("frame")
    exp = r.groupby("proto").cumcount() + 1
    assert (r.packets_total.to_numpy() == exp.to_numpy()).all()


def test_injection(spark):
    s = spark.createDataFrame([(100.0, "a", 20.0), (105.0, "b", 21.0)], "epoch double, ip string, temp double")
    g = inject_sensor(s).toPandas()
    assert len(g) == 52 and g.epoch.max() == 155.0 and (g[g.ip == "10.11.12.17"].temp == 60.0).all()
    p = spark.createDataFrame([(7, 1.0, "x", "y", "TCP", "10", "i")],
                              "frame long, rel double, src string, dst string, proto string, size string, info string")
    f = inject_flood(p, s).toPandas()
    new = f[f.frame > 7]
    assert len(new) == 5000 and new.frame.min() == 8 and new.frame.max() == 5007
    assert new.rel.min() == 6.0 and abs(new.rel.max() - 55.99) < 1e-9


def test_injected_flood_shows_in_tick_counts(spark):
    from pyspark.sql import functions as F
    from flowsentry.operators.alignment import parse_packets, sensor_ticks, translate
    from flowsentry.sources import bindings as B
    from conftest import SF_SMALL
    tk = inject_sensor(B.ticks(spark, SF_SMALL).select("epoch", "ip", "temp"))
    pk = inject_flood(B.packets(spark, SF_SMALL), B.ticks(spark, SF_SMALL))
    good, _ = parse_packets(pk)
    t0 = B.ticks(spark, SF_SMALL).agg(F.min("epoch").alias("t0"))
    al = align_forward(translate(good, "rel_s", t0, "t"), sensor_ticks(tk))
    last = B.ticks(spark, SF_SMALL).agg(F.max("epoch")).first()[0]
    per = packets_per_tick(al, sensor_ticks(tk)).where(F.col("tick") > last + 1).toPandas()
    assert len(per) == 48                      # last injected tick is never flushed
    assert (per.n_packets == 100).all()        # 100 packets per second of flood
