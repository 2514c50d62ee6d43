import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millrace.llm import digests as D
from tests.conftest import rows


def test_error_is_within_the_bound(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 60_000, p=[0.9, 0.0999, 0.0001]), "day": rng.integers(0, 3, 60_000), "x": rng.lognormal(3, 2, 60_000), "y": rng.integers(0, 4, 60_000).astype(float)})
    pdf.loc[::50, "x"] = np.nan
    df = spark.createDataFrame(pdf).repartition(13)
    for keys, found in D.percentiles(df, ["k", "day"], ["x", "y"], union_keys=[["k"]]).items():
        for r in found.collect():
            own = pdf[pdf.k == r.k] if keys == "k" else pdf[(pdf.k == r.k) & (pdf.day == r.day)]
            v = np.sort(own[r.metric].dropna().to_numpy())
            assert r.n == len(v) and r.rank_error <= D.bound(r.n) and r.within
            for q in (0.5, 0.9, 0.95, 0.99):
                rank, at = q * (len(v) - 1), r[f"p{round(q * 100)}"]
                low, high = sorted((np.searchsorted(v, at, "left"), np.searchsorted(v, at, "right") - 1))
                assert max(0, low - rank, rank - high) / len(v) <= min(r.rank_error, D.bound(len(v), q)) + 1e-9


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 10)] + [("b", 7.0), ("c", None), ("d", float("inf")), (None, 1.0), (None, 3.0)], "k string, x double")
    got = {r.k: r for r in D.percentiles(df, ["k"], ["x"])["k"].collect()}
    assert abs(got["a"].p99 - 9.76) < 1e-9 and got["a"].p50 == 3.0 and got["a"].rank_error == 0.0
    assert got["b"].p50 == got["b"].p99 == 7.0 and "c" not in got and "d" not in got


def test_nothing(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert D.percentiles(df, ["k"], ["x"])["k"].count() == 0


def test_merge_of_days_equals_whole(spark):
    df = spark.range(20_000).select((F.col("id") % 5).alias("day"), F.lit("r").alias("run"), (F.col("id") * 37 % 20_011).cast("double").alias("x"))
    days = D.merged(D.digests(df, ["run", "day"], ["x"]), ["run", "day"])[0]
    whole = D.quantiles(D.merged(days, ["run"])[0]).first()
    v = np.array([r.x for r in df.select("x").collect()])
    for q, at in zip((0.5, 0.9, 0.95, 0.99), whole.estimates):
        assert abs((v <= at).mean() - q) < D.bound(len(v), q)
    assert whole.n == 20_000 and days.count() == 5


def test_clusters_are_bounded(spark):
    d = D.merged(D.digests(spark.range(50_000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("x")), ["k"], ["x"], 100), ["k"], 100)[0].first()
    assert len(d.means) <= 101 and d.n == 50_000 and d.low == 0.0 and d.high == 49_999.0 and d.means == sorted(d.means)


def test_bound_depends_on_the_quantile():
    assert D.bound(10**9, 0.99) < 0.005 < D.bound(10**9, 0.5) < 0.012


def test_levels_follow_from_the_number_of_digests(spark):
    df = spark.range(40_000).repartition(24).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 40_009).cast("double").alias("x"))
    parts = D.digests(df, ["k"], ["x"]).cache()
    for fan_in, levels in ((256, 1), (8, 2), (3, 3)):
        whole, n = D.merged(parts, ["k"], fan_in=fan_in)
        got = {r.k: r for r in D.quantiles(whole).collect()}
        assert 1 <= n <= levels and (n > 1) == (fan_in < 24) and sorted(got) == [0, 1] and all(r.n == 20_000 for r in got.values())
        for k, r in got.items():
            v = np.sort(np.array([i * 7919 % 40_009 for i in range(40_000) if i % 2 == k], float))
            assert all(abs((v <= at).mean() - q) < D.bound(len(v), q, levels=1 + n) for q, at in zip((0.5, 0.9, 0.95, 0.99), r.estimates))


def test_many_groups_without_broadcast(spark, monkeypatch):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("k"), (F.col("id") % 7).alias("day"), (F.col("id") * 31 % 9973).cast("double").alias("x"))
    want = {c: sorted(map(tuple, f.collect()), key=str) for c, f in D.percentiles(df, ["k", "day"], ["x"], union_keys=[["k"]]).items()}
    monkeypatch.setattr(D, "SMALL_GROUPS", 0)
    got = {c: sorted(map(tuple, f.collect()), key=str) for c, f in D.percentiles(df, ["k", "day"], ["x"], union_keys=[["k"]]).items()}
    assert got == want and len(want["k"]) == 3 and len(want["k,day"]) == 21
