import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flowsentry.operators.prefix import running_aggregate, top_k_per_group


def test_running_sum_with_hot_key(spark):
    rng = np.random.default_rng(11)
    n = 5000
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"k": key, "o": rng.permutation(n), "v": rng.integers(0, 10, n)})
    df = spark.createDataFrame(pdf)
    got = running_aggregate(df, ["k"], ["o"], "v", "cum", F.floor(F.col("o") / 97)).toPandas()
    exp = pdf.sort_values("o").assign(cum=lambda d: d.groupby("k").v.cumsum())
    m = got.merge(exp, on=["k", "o"])
    assert (m.cum_x == m.cum_y).all() and len(m) == n
    ex = running_aggregate(df, ["k"], ["o"], "v", "prev", F.floor(F.col("o") / 97), inclusive=False).toPandas()
    m2 = ex.merge(exp, on=["k", "o"])
    first = m2.groupby("k").o.transform("min") == m2.o
    assert m2[first].prev.isna().all()
    assert (m2[~first].prev == (m2[~first].cum - m2[~first].v_y)).all()
    mx = running_aggregate(df, ["k"], ["o"], "v", "mx", F.floor(F.col("o") / 97), how="max").toPandas()
    exm = pdf.sort_values("o").assign(mx=lambda d: d.groupby("k").v.cummax())
    assert (mx.merge(exm, on=["k", "o"]).pipe(lambda d: d.mx_x == d.mx_y)).all()


def test_top_k(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["x", "y"], 2000, p=[0.9, 0.1]), "line": rng.permutation(2000)})
    got = top_k_per_group(spark.createDataFrame(pdf), ["g"], ["line"], 20, salt_buckets=8).toPandas()
    exp = pdf.sort_values("line").groupby("g").head(20)
    assert sorted(zip(got.g, got.line)) == sorted(zip(exp.g, exp.line))


def test_exact_quantiles_with_hot_value(spark):
    from flowsentry.operators.stats import exact_quantiles
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 5000):
        x = np.round(rng.exponential(3, n), 2)
        x[: n // 3] = 1.5
        pdf = pd.DataFrame({"g": rng.choice(["a", "b"], n), "x": x})
        probs = [0.0, 0.01, 0.5, 0.99, 1.0]
        got = exact_quantiles(spark.createDataFrame(pdf), "x", probs, by=["g"], accuracy=100) \
            .toPandas().set_index("g").sort_index()
        for gk, sub in pdf.groupby("g"):
            exp = np.percentile(sub.x.to_numpy(), [p * 100 for p in probs])
            assert np.allclose(got.loc[gk].to_numpy(dtype=float), exp, rtol=0, atol=1e-9)


def test_two_level_lag_and_sliced_increase(spark):
    from flowsentry.operators.metrics import counter_increase
    from flowsentry.operators.prefix import two_level_lag
    rng = np.random.default_rng(4)
    n = 4000
    dev = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 4, n))
    ts = np.sort(rng.uniform(0, 1000, n)).round(3)
    pdf = pd.DataFrame({"metric": "c", "device": dev.astype("int32"), "ts": ts, "seq": np.arange(n),
                        "value": rng.integers(0, 50, n).astype(float)})
    df = spark.createDataFrame(pdf)
    got = two_level_lag(df, ["device"], ["ts", "seq"], "value", "prev",
                        F.floor(F.col("ts") / 13).cast("bigint")).toPandas().sort_values("seq")
    exp = pdf.sort_values(["ts", "seq"]).groupby("device").value.shift(1)
    assert np.array_equal(got.prev.fillna(-1).to_numpy(), exp.sort_index().fillna(-1).to_numpy())
    inc = counter_increase(df, 100.0, slice_s=3.0).toPandas()
    p = pdf.assign(b=np.floor(pdf.ts / 100).astype(int)).sort_values(["ts", "seq"])
    p["prev"] = p.groupby("device").value.shift(1)
    p["d"] = np.where(p.prev.isna(), 0.0, np.where(p.value < p.prev, p.value, p.value - p.prev))
    e = p.groupby(["device", "b"]).d.sum()
    g = inc.assign(b=(inc.range_start / 100).astype(int)).set_index(["device", "b"]).increase
    assert np.allclose(g.sort_index().to_numpy(), e.sort_index().to_numpy())


def test_sorted_rank_binary_search(spark):
    from flowsentry.operators.prefix import sorted_rank
    rng = np.random.default_rng(1)
    for n_b in (1, 2, 3, 7, 8, 63):
        b = np.sort(rng.integers(0, 50, n_b).astype(float))
        xs = rng.integers(-2, 53, 300).astype(float)
        df = spark.createDataFrame(pd.DataFrame({"x": xs})).withColumn(
            "b", F.array(*[F.lit(float(v)) for v in b]))
        got = np.array([r[0] for r in sorted_rank(df, "b", "x", "r", n_b).select("r").collect()])
        assert (got == np.searchsorted(b, xs, side="left")).all()
