"""Null ids, repeated rows and columns with clashing names, for each operator."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.llm import copies, digests, leaks, packing, pairs, spans, truncation
from tests.conftest import rows
from tests.llm.test_truncation import corpus

CLASH = ["hash", "n", "key", "check", "start", "size", "part", "rep", "cluster", "rule", "bin", "band", "metric", "means", "ends", "whole"]


def dirty(df, key):
    """The rows twice, one without a key, and columns named like those within the operators."""
    df = df.unionByName(df).unionByName(df.limit(1).withColumn(key, F.lit(None).cast(dict(df.dtypes)[key])))
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


def test_copies(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a B!"), (3, "c"), (4, None)], "id long, p string")
    assert rows(copies.copy_members(copies.keyed(dirty(df, "id"), "id", ["p"]))) == [(1, 2)]


def test_truncation(spark):
    data = corpus(500, 12)
    df = spark.createDataFrame(data, "record_id long, source string, text string, want boolean").withColumn("field_name", F.lit("a"))
    once, twice = (set(rows(truncation.truncated(x).select("record_id"))) for x in (df, dirty(df, "record_id")))
    want = {(k,) for k, *_, c in data if c}
    assert len(once & want) > 0.85 * len(want) and len(twice & want) > 0.85 * len(want)
    got = truncation.truncated(dirty(df, "record_id"))
    assert got.count() == got.distinct().count()


def test_digests(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, x double")
    got = digests.percentiles(dirty(df, "k"), ["k"], ["x"])["k"]
    assert {r.k: r.n for r in got.collect()} == {"a": 4, None: 1}


def test_pairs(spark):
    df = spark.createDataFrame([(1, "Why?", "n/a", "s"), (2, "Why?", "Because it is so.", None)], "example_id long, prompt string, completion string, source string")
    assert rows(pairs.defects(dirty(df, "example_id"))) == [(1, "empty")]


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZERS), reason="no tokenizer files here")
def test_packing(spark):
    df = spark.createDataFrame([(1, "one text", "s"), (2, "another", None)], "doc_id long, text string, source string")
    p = packing.packed(dirty(df, "doc_id"), 64)
    assert sorted(r.doc_id for r in p.collect()) == [1, 1, 2, 2]
    assert p.groupBy("sequence_id", "doc_id").count().where("count > 1").count() == 0


def test_leaks(spark):
    passage = " ".join(f"word{k}" for k in range(20))
    d = spark.createDataFrame([(1, passage), (2, "x")], "doc_id long, text string")
    i = spark.createDataFrame([(7, passage)], "item_id long, text string")
    assert rows(leaks.leaks(dirty(d, "doc_id"), dirty(i, "item_id"))) == [(7, 1)]


def test_spans(spark):
    import random

    rng = random.Random(1)
    t = "".join(rng.choice("abcdefg. ") for _ in range(700))
    df = spark.createDataFrame([(1, t), (2, t), (3, "x" + t[100:400]), (4, "y")], "doc_id long, text string")
    assert set(rows(spans.pairs(dirty(df, "doc_id")))) == {(1, 2), (1, 3), (2, 3)}
    got = {r.doc_id: r.shared_chars for r in spans.shares(dirty(df, "doc_id")).collect()}
    assert got == {1: 700, 2: 700, 3: 300}
