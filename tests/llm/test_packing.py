import os

import pytest
from pyspark.sql import functions as F

from millrace.llm import packing
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.exists(packing.TOKENIZERS), reason="no tokenizer files here")


def test_plan_is_whole_and_tight(spark):
    df = spark.range(1500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("alpha beta "), (F.col("id") * 37 % 300 + 1).cast("int")).alias("text"), (F.col("id") % 5).cast("string").alias("source"))
    df = df.withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    p = packing.packed(df, capacity=256).persist()
    n = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    assert dict(rows(p.groupBy("doc_id").agg(F.sum("size")))) == n
    fill = {r[0]: r[1] for r in rows(p.groupBy("sequence_id").agg(F.sum("size")))}
    assert max(fill.values()) <= 256
    cut = {r.doc_id for r in p.where("piece > 0").collect()}
    assert cut == {k for k, v in n.items() if v > 256}
    s = packing.padding(p, 256).first()
    assert s.tokens == sum(n.values()) and s.padding_share < 0.01 and s.sequences >= s.least
    for rows_of in p.orderBy("sequence_id", "slot").toPandas().groupby("sequence_id"):
        at = 0
        for r in rows_of[1].itertuples():
            assert r.offset == at
            at += r.size
    starts = p.where("doc_id = 299").orderBy("piece").collect()
    assert [r.start for r in starts] == [256 * r.piece for r in starts]


def test_copies_part(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("one and the same text").alias("text"), F.lit(None).cast("string").alias("source"))
    p = packing.packed(df, capacity=64)
    assert p.select("sequence_id").distinct().count() == 40


def test_sources_part(spark):
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    p = packing.packed(df, capacity=64, one_of_source=True).join(df.select("doc_id", "source"), "doc_id")
    assert p.groupBy("sequence_id", "source").count().where("count > 1").count() == 0


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "word " * 5000, None), (4, "x", "a"), (5, "<|endoftext|>", "a")], "doc_id long, text string, source string")
    p = packing.packed(df, capacity=128)
    assert {r.doc_id for r in p.collect()} == {3, 4, 5}
    assert p.where("doc_id = 3 and size < 128").count() <= 1 and p.where("doc_id = 5").first()["size"] > 1
    assert packing.packed(df.where("false")).count() == 0
    e = packing.padding(packing.packed(df.where("false"))).first()
    assert (e.sequences, e.tokens, e.padding_share) == (0, 0, None)


def test_tightest_room_is_taken():
    bins = packing.Sequences(10)
    assert [bins.place(s, 0, 1 << k)[0][0] for k, s in enumerate([7, 6, 4, 3, 10])] == [0, 1, 1, 0, 2]
    bins = packing.Sequences(10)
    assert [bins.place(s, 0, b)[0][0] for s, b in [(7, 1), (6, 2), (3, 1), (3, 4)]] == [0, 1, 1, 0]
    bins = packing.Sequences(10)
    assert [p[0] for s, b, n in [(7, 1, 1), (5, 2, 2), (3, 4, 4)] for p in bins.place(s, 0, b, n)] == [0, 1, 2, 0, 2, 1, 3]
    bins = packing.Sequences(10, 2)
    assert [bins.place(s, k, 1 << j)[0][0] for j, (s, k) in enumerate([(4, 0), (3, 0), (3, 1), (2, 1), (2, 0)])] == [0, 1, 0, 1, 2]


def test_groups(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    p = packing.packed(df, capacity=64, group_tokens=300)
    assert p.count() == 300 and p.select(F.split("sequence_id", "-")[0]).distinct().count() > 1


def test_equal_texts_take_linear_time():
    """100,000 copies of one text, and as many texts of one source where a sequence takes one of each."""
    import time

    import pandas as pd

    n = 100_000
    equal = pd.DataFrame({"doc_id": range(n), "piece": 0, "start": 0, "size": 10, "source": "a", "cluster": 7})
    for frame, one in ((equal, False), (equal.assign(cluster=range(n)), True), (equal.assign(source=["a", "b", "c", "a"] * (n // 4), cluster=range(n), size=[10, 20, 30, 40] * (n // 4)), True)):
        began = time.time()
        p = packing.fill(frame, 2048, one, "g")
        assert time.time() - began < 30 and len(p) == n
        if not one:
            assert p["sequence_id"].nunique() == n
        else:
            assert not p.merge(frame[["doc_id", "source"]]).duplicated(["sequence_id", "source"]).any()


def test_copies_in_another_look_part(spark):
    df = spark.createDataFrame([(1, "One and the same!", "a"), (2, "one AND the same", "a"), (3, "---", "a"), (4, "***", "a"), (5, "other", "b")], "doc_id long, text string, source string")
    at = {r.doc_id: r.sequence_id for r in packing.packed(df, capacity=64).collect()}
    assert at[1] != at[2] and len(at) == 5
