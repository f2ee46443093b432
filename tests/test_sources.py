import os

from pyspark.sql import functions as F

from flowsentry.operators.alignment import parse_packets, sensor_ticks
from flowsentry.session import scratch_path
from flowsentry.sources.files import read_device_stats, read_flows, read_packets, read_sensor


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(text)


def test_sensor_by_position_with_bad_rows(spark):
    d = scratch_path(spark, "t-sensor").replace("file:", "")
    fill = ",False" * 23
    _write(d, "s.csv", "h0,h1,h2,h3" + fill + "\n"
           f"100.5,2,10.11.12.1,20.5{fill}\n" f"oops,2,10.11.12.2,21.0{fill}\n" f"101.0,2,10.11.12.3,bad{fill}\n")
    s = read_sensor(spark, d).collect()
    assert [(r.epoch, r.ip, r.temp) for r in s] == [(100.5, "10.11.12.1", 20.5), (None, "10.11.12.2", 21.0),
                                                   (101.0, "10.11.12.3", None)]
    assert sorted(r.tick for r in sensor_ticks(read_sensor(spark, d)).collect()) == [100.5, 101.0]


def test_packets_rejects(spark):
    d = scratch_path(spark, "t-packets").replace("file:", "")
    _write(d, "p.csv", "frame,time,src,dst,proto,len,info\n1,0.5,a,b,TCP,60,x\n2,zz,a,b,UDP,60,x\n3,0.7,a,b,UDP,big,x\n")
    good, bad = parse_packets(read_packets(spark, d))
    assert [r.frame for r in good.collect()] == [1]
    assert sorted((r.frame, r.reject_reason) for r in bad.collect()) == [(2, "rel_s"), (3, "size_b")]


def test_flow_csv_keeps_dirty_text_and_tsv(spark):
    d = scratch_path(spark, "t-flows").replace("file:", "")
    _write(d, "f.csv", "event_id,ts,src_ip,proto,duration,src_bytes,dst_bytes,src_pkts,dst_pkts,label\n"
           "1,10.0,a,tcp,-,-,12,-,3,0\n")
    r = read_flows(spark, d).first()
    assert (r.duration, r.src_bytes, r.label) == ("-", "-", 0)
    t = scratch_path(spark, "t-tsv").replace("file:", "")
    _write(t, "s.txt", "sample\tcpu_pct\tmem_mb\tstatus\n1\t0.9975\t721.3\tok\n2\t1.0000\t721.4\tok\n")
    assert [(x.sample, x.mem_mb) for x in read_device_stats(spark, t).collect()] == [(1, 721.3), (2, 721.4)]


def test_day_partitioned_flows_prune(spark):
    from flowsentry.sources.files import read_flows_between, write_flows_by_day
    rows = [(float(86400 * d + 10 * i), "1", 0) for d in range(3) for i in range(5)]
    df = spark.createDataFrame(rows, "ts double, duration string, label int")
    path = scratch_path(spark, "t-byday")
    write_flows_by_day(df, path)
    got = read_flows_between(spark, path, 86400.0, 86400.0 + 25)
    assert sorted(r.ts for r in got.collect()) == [86400.0, 86410.0, 86420.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters" in plan


def test_session_cluster_conf():
    from flowsentry.session import cluster_conf
    c = cluster_conf()
    assert c["spark.sql.adaptive.enabled"] == "true" and c["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_every_line_is_good_or_rejected(spark, tmp_path):
    from pyspark.sql import types as T

    from flowsentry.sources.files import read_csv_checked
    lines = ["a,b,c", "1,x,2.5", '2,"y, z",3', "3,short", "4,x,1,extra,more", '5,"open,1', "x,x,1", "", "6,,", '7,"a ""b""",1']
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.DoubleType())])
    good, rejects = read_csv_checked(spark, str(tmp_path / "f.csv"), schema, header="a,b,c")
    assert sorted(map(tuple, good.collect())) == [(1, "x", 2.5), (2, "y, z", 3.0), (6, None, None), (7, 'a "b"', 1.0)]
    assert {r.line: r.reason for r in rejects.collect()} == {
        "3,short": "too few fields", "4,x,1,extra,more": "too many fields", '5,"open,1': "open quote", "x,x,1": "bad value"}
    assert good.count() + rejects.count() == 8
    assert good.select("a").count() + rejects.select("reason").count() == 8  # whatever columns are read


def test_gate_sums_come_with_the_scan(spark):
    from pyspark.sql import Observation

    from flowsentry.operators.cleaning import gate_row, gated_flows, quality_gate, clean_flows
    from flowsentry.session import scratch_path
    from flowsentry.streaming.progress import recorded
    raw = spark.createDataFrame([(float(i), ["1", "0", "x", "1e999"][i % 4], "5", "-", int(i % 3 == 0)) for i in range(40)],
                                "ts double, duration string, src_bytes string, dst_bytes string, label int")
    own, seen = spark.newSession(), Observation()
    raw.write.parquet(whole := scratch_path(spark, "t-gate-all"))
    assert gated_flows(own.read.parquet(whole), watch=seen).where("duration > 0").count() == 10
    assert gate_row(spark, seen.get).collect() == quality_gate(clean_flows(raw), raw=raw).collect()
    plan = gated_flows(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    # per micro-batch, as metric samples
    for i in range(2):
        raw.where(f"ts >= {20 * i} and ts < {20 * i + 20}").coalesce(1).write.parquet(f"{(src := scratch_path(spark, 't-gate'))}")
        if i == 0:
            first = src
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(first)
    got = recorded(spark, scratch_path(spark, "t-gate-metrics"), lambda: gated_flows(stream).writeStream.format("noop").option(
        "checkpointLocation", scratch_path(spark, "t-gate-ck")).trigger(availableNow=True).start())
    sums = {r.metric: r.value for r in got.where("metric like 'flow_gate.%'").collect()}
    assert sums == {"flow_gate.n_rows": 20.0, "flow_gate.n_valid": 5.0, "flow_gate.n_attack": sums["flow_gate.n_attack"],
                    "flow_gate.n_infinite": 5.0}
