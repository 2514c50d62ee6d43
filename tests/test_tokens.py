import os

import pytest
from pyspark.sql import functions as F

from millrace.functions import tokens
from millrace.operators import dpo, sft
from tests.conftest import rows

here = pytest.mark.skipif(not os.path.isdir(tokens.FOLDER), reason="no tokenizer files here")


@here
@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    texts = ["Why is it so?", "", None, "<|endoftext|>", "Straße 42 \U0001f600"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = dict(rows(df.select("k", tokens.count(F.col("t"), name).alias("n")), "k"))
    assert got == {k: len(tokens.encoder(tokens.known(name))([t or ""])[0]) for k, t in enumerate(texts)} and got[3] > 1 and got[1] == got[2] == 0


@here
def test_chat_lengths(spark):
    df = spark.createDataFrame([(1, "Why?", "So it is."), (2, "Why?", ""), (3, "a" * 50, "b " * 400)], "ordinal int, prompt string, completion string")
    got = {r.ordinal: r for r in sft.featurised(sft.extracted(df), 64, "byte_bpe_50k.tiktoken").collect()}
    encode = tokens.encoder(tokens.known("byte_bpe_50k.tiktoken"))
    head = encode([tokens.TEMPLATE[0].format("Why?")])[0]
    assert got[1].prompt_len == len(head) and got[1].raw_len == len(encode([tokens.TEMPLATE[0].format("Why?") + "So it is.\n"])[0]) and got[1].boundary_ok
    assert got[3].truncated and got[3].total_len == 64 and not got[1].truncated and got[2].empty


@here
def test_boundary_inside_a_token(spark):
    df = spark.createDataFrame([(1, "hel", "lo")], "ordinal int, p string, c string")
    assert not sft.featurised(df, 64, "byte_bpe_50k.tiktoken", ("{}", "{}")).first().boundary_ok


def test_missing_tokenizer(spark):
    df = spark.createDataFrame([(1, "Why?", "")], "ordinal int, prompt string, completion string")
    with pytest.raises(tokens.UnknownTokenizer):
        sft.featurised(sft.extracted(df), tokens="no such")
    r = sft.report(df, tokens="no such").first()
    assert r.gate == "Unable to Inspect" and r.warnings == ["tokenizer"] and r.total == r.invalid == r.empty == r.n == 0 and r["mean"] == 0.0


def test_advice(spark):
    df = spark.createDataFrame([(k, "Why?", "So. " * (1 if k % 2 else 60)) for k in range(8)] + [(9, "", "x")], "ordinal int, prompt string, completion string")
    got = {r.kind: (r.severity, r.n, round(r.share_pct, 3)) for r in sft.advice(sft.report(df), 0.01).collect()}
    assert got["duplicates"] == ("advice", 7, 77.778) and got["invalid"] == ("error", 1, 11.111) and got["drift"][2] == 0.01 and got["padding"][2] > 20 and set(got) == {"duplicates", "invalid", "drift", "padding"}
    a, b = spark.range(100).select(F.col("id").alias("v")), spark.range(100).select((F.col("id") + 90).alias("v"))
    assert sft.drift(a, b)[1] < 0.05 < sft.drift(a, a)[1] and sft.drift(a, b.where("false")) == (0.0, 1.0)


@here
def test_preference_lengths(spark):
    df = spark.createDataFrame([("Why?", "So it is.", None)], "prompt string, chosen_text string, rejected_text string")
    r = dpo.token_lengths(df, "byte_bpe_50k.tiktoken").first()
    encode = tokens.encoder(tokens.known("byte_bpe_50k.tiktoken"))
    assert (r.prompt_len, r.chosen_len, r.rejected_len) == (len(encode([tokens.TEMPLATE[0].format("Why?")])[0]), len(encode(["So it is."])[0]), 0)
