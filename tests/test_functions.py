import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.functions import numeric, stats, text
from tests.conftest import rows


def test_text(spark):
    df = spark.createDataFrame([(1, "\t  a b \n"), (2, ""), (3, None), (4, "Naïve étion_x 42")], "k int, s string")
    got = {r.k: r for r in df.select("k", text.py_strip(F.col("s")).alias("s"), text.words(F.col("s")).alias("w"), text.tokens_quarter(F.col("s")).alias("n")).collect()}
    assert got[1].s == "a b" and got[1].w == ["a", "b"] and got[1].n == 1
    assert got[2].s == "" and got[2].n == 1
    assert got[3].s is None and got[3].w is None
    assert got[4].w == ["naïve", "étion_x", "42"]


def test_jaccard(spark):
    df = spark.createDataFrame([("a b c", "A B d"), ("", "a"), (None, "a"), ("x", "x")], "a string, b string")
    assert [r[0] for r in df.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, None, 1.0]


def test_bigrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(text.bigrams(F.col("w"))).collect()]
    assert [tuple(x) for x in got[0]] == [("a", "b"), ("b", "c")] and got[1] is None and got[2] is None


def test_distribution_and_empty(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "x double")
    d = df.agg(*[c.alias(k) for k, c in stats.distribution(F.col("x")).items()]).first()
    assert d["mean"] == 4.0 and d["p50"] == 3.0 and math.isclose(d["p99"], 9.76)
    assert df.where("false").agg(*[c.alias(k) for k, c in stats.distribution(F.col("x")).items()]).first()["mean"] is None


def test_sample_std(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 10.0), (2, 12.0), (2, 14.0)], "g int, x double")
    assert rows(df.groupBy("g").agg(F.avg("x"), stats.sample_std(F.col("x"))), "g") == [(1, 10.0, 0.0), (2, 12.0, 2.0)]


def test_histogram(spark):
    one = spark.createDataFrame([(5,)] * 3, "x int")
    assert rows(stats.histogram(one, "x", 4)) == [(2, 3)]
    df = spark.range(101).select(F.col("id").alias("x"))
    assert rows(stats.histogram(df, "x", 4), "bin") == [(0, 25), (1, 25), (2, 25), (3, 26)]
    assert rows(stats.histogram(one.where("false"), "x")) == []


def test_ks(spark):
    a = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "v int")
    b = spark.createDataFrame([(x,) for x in (3, 4, 5, 6)], "v int")
    r = stats.ks_statistic(a, b).first()
    assert (r.d, r.n, r.m) == (0.5, 4, 4)
    assert math.isclose(stats.ks_p_value(0.5, 4, 4), 0.7714285714285715)
    assert stats.ks_p_value(0.0, 10, 10) == 1.0 and stats.ks_p_value(0.5, 0, 4) == 1.0
    assert stats.ks_p_value(0.2, 20_000, 20_000) < 0.05 < stats.ks_p_value(0.005, 20_000, 20_000)


@pytest.mark.parametrize("text_,target", [("42.0", "42"), ("1,234,567", "1234567"), ("$100", "100"), ("-$50", "-50"), ("50$", "50"), ("- 15", "-15"), (r"\frac{3}{4}", ".75"), ("2/4", "1/2"), ("50%", ".5"), ("so 42 apples.", "42"), ("The final answer is 7", "7"), ("x = 5", "5"), ("#### 9", "9"), ("3/4 cup", ".75"), ("$-5", "-5"), ("it is -5.", "-5"), ("1,000.50", "1000.5")])
def test_numbers_that_agree(text_, target):
    assert numeric.exact_number(text_) == numeric.exact_number(target) is not None


@pytest.mark.parametrize("text_", ["1,2,3", "1,00", "5/0", "42 or 43", "50kg", "", None, "9" * 21, "x" * 65, "NaN", "Infinity", "1e16", "1e999999999", "1.2.3", "5 6", "50% of them", "1/2/3", "42,", "1,000 apples", "a50", "either 5"])
def test_numbers_that_are_none(text_):
    assert numeric.exact_number(text_) is None


def test_percent_is_no_whole():
    assert numeric.exact_number("50%") == Fraction(1, 2) != numeric.exact_number("50")


def test_golden_pairs():
    assert all(numeric.equivalent(a, b) and numeric.equivalent(b, a) for a, b in numeric.GOLDEN)
    assert not any(numeric.equivalent(a, b) for a, b in [*numeric.DIFFERENT, (None, "1"), ("1", None)])


@pytest.mark.parametrize("a,b", [("(x+1)^2", "x^2 + 2*x + 1"), ("x * y", "y*x"), (r"\frac{a}{b}", "a/b"), ("5 kg", "5"), ("2 apples", "2 apples"), ("-(3 - 5)", "2"), ("2^-1", "50%"), ("1e400", "1e400")])
def test_equivalent_expressions(a, b):
    assert numeric.equivalent(a, b)


@pytest.mark.parametrize("a,b", [("(x+1)^2", "x^2 + 1"), ("2 apples", "2"), ("1e400", "1e401"), ("9^99999", "9^99998"), ("(" * 300 + "1", "1"), ("1/(1-1)", "1")])
def test_different_expressions(a, b):
    assert not numeric.equivalent(a, b)


def test_answers(spark):
    cases = [
        ("<think>a</think> <answer> 42 </answer>", "42"), ("<answer>1</answer><answer>2</answer>", None), ("<answer>1", None), ("</answer>1<answer>", None), ("so #### 7 apples", "7"), ("The final answer is 42, right", "42,"),
        ("answer: 5 then 6", "6"), ("plain 1234", "4"), ("<think>9</think> 12", "12"), ("", None), (None, None), ("x" * 5000, None), ("none", None), ("<answer></answer>", None),
    ]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, c string")
    got = dict(rows(df.select("k", numeric.answer_text(F.col("c")))))
    assert got == {k: w for k, (_, w) in enumerate(cases)}
    strict = df.where("k = 7").select(numeric.answer_text(F.col("c"), strict_numbers=True)).first()[0]
    assert strict == "1234"


def test_accuracy(spark):
    df = spark.createDataFrame([("<answer>1,000</answer>", "x #### 1000"), ("<answer>2</answer>", "3"), (None, "3"), ("<answer>3</answer>", None)], "c string, t string")
    assert [r[0] for r in df.select(numeric.accuracy(F.col("c"), F.col("t"))).collect()] == [True, False, False, False]


@pytest.mark.parametrize("small,accuracy", [(100_000, 10_000), (10, 10_000), (10, 200)])
def test_exact_percentiles(spark, small, accuracy):
    import numpy as np

    rng = np.random.default_rng(2)
    inf = float("inf")
    x = [*rng.lognormal(0, 3, 20_000), 1e12, -5.0]
    data = [("a", float(v)) for v in x] + [("b", 7.0)] * 500 + [("b", 8.0)] + [("c", 1.5)] + [("d", None), ("d", float("nan"))] + [(None, 2.0), (None, 4.0)] + [("e", inf)] * 3 + [("e", float(k)) for k in range(200)] + [("e", -inf)]
    df = spark.createDataFrame(data, "k string, x double")
    qs = (0.0, 0.5, 0.9, 0.99, 1.0)
    got = {r.k: r for r in stats.exact_percentiles(df, ["k"], {"v": F.col("x"), "twice": F.col("x") * 2}, qs, small, accuracy).collect()}
    assert set(got) == {"a", "b", "c", "d", "e", None} and got["d"].v_n == 0 and got["d"].v is None
    for k in ("a", "b", "c", "e", None):
        own = [v for key, v in data if key == k]
        assert got[k].v_n == len(own) and np.allclose(got[k].v, quantiles_of(own, qs), rtol=1e-12)
        assert np.allclose(got[k].twice, [2 * v for v in got[k].v])
    whole = stats.exact_percentiles(df, [], {"v": F.col("x")}, (0.5,), small, accuracy).first()
    assert whole.v_n == len(data) - 2
    assert stats.exact_percentiles(df.where("false"), ["k"], {"v": F.col("x")}, (0.5,)).count() == 0


def quantiles_of(values, qs):
    """Linear between ranks, with infinite values."""
    v = sorted(values)
    out = []
    for q in qs:
        at = q * (len(v) - 1)
        low, high = v[math.floor(at)], v[math.ceil(at)]
        out.append(low if low == high else low + (high - low) * (at - math.floor(at)))
    return out
