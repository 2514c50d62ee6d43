import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language, pairs
from millrace.llm import truncation as T
from tests.llm import held_out
from tests.llm.test_truncation import corpus


def answers(spark, n, seed):
    return spark.createDataFrame(corpus(n, seed), "record_id long, source string, text string, want boolean").withColumn("field_name", F.lit("answer"))


def test_no_verdict_comes_from_a_sample(spark, monkeypatch):
    df = answers(spark, 600, 21)
    want = {r.record_id: (r.log_odds, r.cut) for r in T.judged(df).collect()}
    monkeypatch.setattr(T, "sampled", lambda values, *_: values.where("false"))
    assert {r.record_id: (r.log_odds, r.cut) for r in T.judged(df).collect()} == want and len(want) > 50


def test_a_filter_of_any_size_loses_no_count(spark, monkeypatch):
    df = answers(spark, 600, 22)
    own = T.endings(T.finals(df))
    asked = {r[k] for r in own.collect() for k in ("key2", "key3", "key4")}
    all_of = {r.key: (r.went_on, r.ended) for r in T.long_counts(df).collect()}
    want = {k: v for k, v in all_of.items() if k in asked}
    sent = []
    for most in (T.MOST_BITS, 8):  # the smaller one lets more keys pass
        monkeypatch.setattr(T, "MOST_BITS", most)
        known = T.known_keys(own)
        got = {r.key: (r.went_on, r.ended) for r in T._long(T.counted(df, spark.sparkContext.broadcast(known))).collect()}
        assert {k: v for k, v in got.items() if k in asked} == want and len(want) > 100
        sent.append(len(got))
    assert sent[0] < sent[1] <= len(all_of)


def test_parts_of_a_long_text_lose_no_context(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "bc", ". ", "!", " ", "   ", "\n" * 30, "。", "?)", "7"]) for _ in range(400)) for _ in range(20)]
    whole, parts = T.Counts(), T.Counts()
    whole.add(texts)
    monkeypatch.setattr(T, "BATCH_CHARS", 60)
    for held, around in T.in_batches(texts):
        assert max(map(len, held)) < 900 < len(texts[0])
        parts.add(held, around)
    assert np.array_equal(whole.dense, parts.dense)
    (a,), (b,) = whole.long(), parts.long()
    assert a.sort_values("key").to_numpy().tolist() == b.sort_values("key").to_numpy().tolist()


def test_held_keys_are_summed(monkeypatch):
    texts = [t for _, _, t, _ in corpus(200, 6)]
    counts, out = T.Counts(), []
    for at in range(0, 200, 10):
        counts.add(texts[at : at + 10])
        out += list(counts.overflow(3000))
    out += list(counts.long())
    whole = T.Counts()
    whole.add(texts)
    (want,) = whole.long()
    got = {}
    for frame in out:
        for r in frame.itertuples():
            a, b = got.get(r.key, (0, 0))
            got[r.key] = a + r.went_on, b + r.ended
    assert got == {r.key: (r.went_on, r.ended) for r in want.itertuples()}


MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def examples(spark):
    return spark.read.parquet(f"{MEDIUM}/sft_examples.parquet").where("completion is not null and length(trim(prompt)) > 0").select("example_id", "prompt", "completion", "source").cache()


@pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="no test tables here")
def test_models_of_pairs_are_those_of_all_pairs(spark, examples):
    parts = pairs.read_once(examples.repartition(5)).cache()
    got = pairs.Rules(None, pairs.profiles_of(parts), *pairs.refusal_model(parts))
    want = pairs.Rules.fitted(spark, examples.select("prompt", "completion").toPandas())
    assert np.allclose(got.weights, want.weights, rtol=1e-6, atol=1e-6) and abs(got.least - want.least) < 1e-6 and want.least <= 1
    assert got.profiles.totals == want.profiles.totals and got.profiles.scores == want.profiles.scores
    assert len(want.profiles.usual) > 1 and got.profiles.usual.keys() == want.profiles.usual.keys()
    assert all(np.allclose(got.profiles.usual[k], want.profiles.usual[k]) for k in want.profiles.usual)


@pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="no test tables here")
def test_long_pairs_are_fitted_on_too(spark, examples):
    long = examples.withColumn("prompt", F.concat("prompt", F.repeat(F.lit(" "), 20_001)))
    tried = [(10**9 + k, p, c, "held out") for k, (p, c) in enumerate(held_out.FOREIGN + held_out.NATIVE)]
    got = {r.example_id - 10**9 for r in pairs.defects(long.unionByName(spark.createDataFrame(tried, examples.schema))).where("defect = 'language'").collect() if r.example_id >= 10**9}
    n = len(held_out.FOREIGN)
    assert sum(k < n for k in got) >= 0.9 * n and sum(k >= n for k in got) <= 1


def test_a_language_text_is_scored_without_itself():
    texts = ["The queue is full and the worker is at the end of the line with a small cache."] * 1 + ["Die Grenze liegt bei der Anfrage und nicht bei dem Verteiler, weil sie klein ist."] * 1
    told = [t for t in map(language.clear, texts) if t]
    fit = language.Profiles(grams=language.grams_of(told))
    (x, n), (y, m) = fit.scored(told)["en", True], fit.scored(told)["en", False]
    assert n == m == 1 and x < y  # without itself its language has nothing left, not even what the other has in common
