import random

from pyspark.sql import functions as F

from millrace.llm import truncation as T
from tests.conftest import rows

NOUNS = ["the scheduler", "a cold cache", "the second worker", "our router", "the audit job", "one replica"]
VERBS = ["restored", "delayed", "masked", "halved", "doubled"]
ENDS = ["within minutes", "on the small cards", "before the release", "after the restart", "in the third region"]


def sentence(rng):
    return f"{rng.choice(NOUNS).capitalize()} {rng.choice(VERBS)} {rng.choice(NOUNS)} by {rng.randint(10, 99)} percent {rng.choice(ENDS)}, and {rng.choice(NOUNS)} followed"


def corpus(n, seed):
    """(id, source, text, cut): a third of one source's complete answers lack their last stop."""
    rng, out = random.Random(seed), []
    for k in range(n):
        text = ". ".join(sentence(rng) for _ in range(rng.randint(2, 6))) + "."
        source, cut = rng.choice("abc"), False
        if source == "b" and rng.random() < 0.3:
            text = text[:-1]
        elif rng.random() < 0.1:
            at = rng.randint(len(text) // 3, len(text) - 12)
            while text[at - 1] in ". " or text[at] == ".":
                at += 1
            text, cut = text[:at] + rng.choice(["", "", "...", " [truncated]"]), True
        out.append((k, source, text, cut))
    return out


def test_held_out_accuracy(spark):
    data = corpus(3000, 5)
    df = spark.createDataFrame(data, "record_id long, source string, text string, want boolean").withColumn("field_name", F.lit("answer"))
    got = {r.record_id for r in T.truncated(df).collect()}
    want = {k for k, _, _, c in data if c}
    hit = len(got & want)
    assert hit / len(want) > 0.93 and hit / len(got) > 0.93
    shares = {r.source: r for r in T.truncation_shares(df).collect()}
    assert sum(r.answers for r in shares.values()) == 3000 and sum(r.cut for r in shares.values()) == len(got)


def test_special_values(spark):
    data = corpus(600, 6)
    odd = [("open", "Use this:\n```\nfor x in y:\n"), ("closed", "Use this:\n```\nx = 1\n```"), ("blank", "  "), ("none", None), ("empty", ""), ("word", "Rarely"), ("stand-in", "(no answer)"), ("dots", "..."), ("long", ("The scheduler restored our router within minutes. " * 40_000).strip())]
    values = [(k, s, t) for k, s, t, _ in data] + [(10_000 + k, None, t) for k, (_, t) in enumerate(odd)]
    df = spark.createDataFrame(values, "record_id long, source string, text string").withColumn("field_name", F.lit("answer"))
    got = {odd[r.record_id - 10_000][0] for r in T.truncated(df).collect() if r.record_id >= 10_000}
    assert got == {"open"}
    assert any(r.source is None and r.cut == 1 for r in T.truncation_shares(df).collect())


def test_nothing(spark):
    df = spark.createDataFrame([], "record_id long, field_name string, source string, text string")
    assert T.truncated(df).count() == 0 and T.truncation_shares(df).count() == 0


def test_marks():
    assert T.stripped("the end...") == ("the end", True) and T.stripped("the en [tr") == ("the en", True) and T.stripped("x �") == ("x", True)
    assert T.stripped("It ends" + "." * 200) == ("It ends", True) and T.stripped("It ends" + " ..." * 500) == ("It ends", True) and T.stripped("." * 900) == ("." * 900, False)
    assert T.stripped("...") == ("...", False) and T.stripped("A whole one. ") == ("A whole one.", False) and T.stripped("half \\u00") == ("half", True)


def test_length_spikes(spark):
    data = [(k, "s", "x" * (1000 if k < 40 else 300 + 9 * k)) for k in range(200)]
    df = spark.createDataFrame(data, "record_id long, source string, text string").withColumn("field_name", F.lit("a"))
    assert {(r.unit, r["size"]) for r in T._spikes(T.sizes_of(df)).collect()} == {("n_chars", 1000), ("n_bytes", 1000)}


def test_counts_are_exact(spark):
    counts = T.Counts()
    counts.add(["ab cd. ab ce", "ab cd."])
    (long,), (short,) = counts.long(), counts.short()
    by_key = {r.key: (r.went_on, r.ended) for r in long.itertuples()}
    codes, ends = T.folded(["ab cd"])
    key = int(T._keys(T.WindowHashes(codes).quick(8)[ends[1:] - 8], 2)[0])
    assert by_key[key] == (0, 2) and len(short) > 0


def test_length_limit_of_an_unnamed_source(spark):
    rows_ = spark.createDataFrame([(1, None, "answer", 200, 210), (2, "a", "answer", 200, 210), (3, None, None, 200, 211), (4, None, "answer", 201, 9)], "record_id long, source string, field_name string, n_chars int, n_bytes int")
    chars = spark.createDataFrame([(None, "answer", 200, 3.0), ("a", "answer", 200, 2.0), (None, None, 200, 1.0)], "source string, field_name string, n_chars int, x_chars double")
    nbytes = spark.createDataFrame([(None, "answer", 210, 4.0)], "source string, field_name string, n_bytes int, x_bytes double")
    got = T.with_excess(rows_, chars, nbytes)
    assert got.columns == [*rows_.columns, "x_chars", "x_bytes"]
    assert rows(got.select("record_id", "x_chars", "x_bytes"), "record_id") == [(1, 3.0, 4.0), (2, 2.0, None), (3, 1.0, None), (4, None, None)]


def test_limit_counts_the_same_without_a_source_name(spark):
    data = [(k, "b", t, c) for k, _, t, c in corpus(400, 11)] + [(1000 + k, "b", ("The audit job delayed the scheduler by 12 percent within minutes, and our router followed. " * 3 + s)[:260], True) for k, s in enumerate(sentence(random.Random(7 + k)) for k in range(30))]
    df = spark.createDataFrame(data, "record_id long, source string, text string, want boolean").withColumn("field_name", F.lit("answer"))
    named, unnamed = ({r.record_id: round(r.log_odds, 6) for r in T.judged(x).collect()} for x in (df, df.withColumn("source", F.lit(None).cast("string"))))
    assert named == unnamed and len(named) >= 30


def test_scripts_without_spaces(spark):
    rng = random.Random(3)
    who, did, what = "调度器 路由器 审计任务 备用节点".split(), "恢复了 延迟了 减少了 检查了".split(), "冷缓存的命中率 第二个工作线程 所有的旧副本 夜间的批量请求".split()
    data = []
    for k in range(1200):
        text = "".join(rng.choice(who) + rng.choice(did) + rng.choice(what) + "。" for _ in range(3))
        cut_off = k % 10 == 0
        data.append((k, "zh", "answer", text[: len(text) - rng.randint(2, 4)] if cut_off else text, cut_off))
    df = spark.createDataFrame(data, "record_id long, source string, field_name string, text string, want boolean")
    got, want = {r.record_id for r in T.truncated(df).collect()}, {r[0] for r in data if r[4]}
    assert len(got & want) > 0.9 * len(want) and len(got & want) > 0.9 * len(got)


def test_sample_is_bounded_and_covers_strata(spark):
    data = [(k, s, "answer", t) for s, n in (("large", 4000), ("middle", 400), ("small", 20), (None, 100)) for k, t in enumerate(["Some words that make up a text."] * n)] + [(k, "large", "answer", "Немного слов, из которых текст.") for k in range(60)]
    df = spark.createDataFrame(data, "record_id long, source string, field_name string, text string")
    sizes = T.sizes_of(df)
    for chars in (10_000, 20_000, 40_000):
        got = T.sampled(df, sizes, chars)
        by = {(r.source, r.c): r.n for r in got.groupBy("source", F.substring("text", 1, 1).alias("c")).agg(F.sum(F.length("text")).alias("n")).collect()}
        assert sum(by.values()) < 1.25 * chars and len(by) == 5
        assert by[("large", "S")] < 0.6 * chars and by[("small", "S")] == 20 * 31
    assert T.sampled(df, sizes, 10**9).count() == len(data)


def test_sampled_model_finds_the_same(spark):
    data = corpus(3000, 9)
    df = spark.createDataFrame(data, "record_id long, source string, text string, want boolean").withColumn("field_name", F.lit("answer"))
    want = {k for k, _, _, c in data if c}
    chars = sum(len(t) for _, _, t, _ in data)
    got = {r.record_id for r in T.judged(df, chars // 3).where("cut").collect()}
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.9


def test_model_rows_for_a_character_do_not_grow(spark):
    texts = [t for _, _, t, _ in corpus(1200, 4)]
    few, many = (spark.createDataFrame([(t,) for t in x], "text string") for x in (texts[:400], texts))
    n = [T.long_counts(x).count() / x.agg(F.sum(F.length("text"))).first()[0] for x in (few, many)]
    assert n[1] <= n[0]


def test_hot_ending(spark):
    from millrace.llm import joins

    rows_ = spark.range(30_000).select((F.col("id") % 3 * F.col("id") % 1000).alias("k"), "id")
    unique = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = joins.with_hot_keys(rows_, unique, ["k"])
    assert sorted(map(tuple, got.select("id", "v").collect())) == sorted(map(tuple, rows_.join(unique, "k").select("id", "v").collect()))
