import pytest
from pyspark.sql import functions as F

from millrace.operators import grpo, rewards
from millrace.operators import monitors as M
from tests.conftest import rows


def test_format(spark):
    cases = [("<think>a</think><answer>1</answer>", True), ("<think>a<answer>1</answer></think>", True), ("<think>\na\n</think>\n<answer>1</answer>", True), ("<answer>1</answer><think>a</think>", False), ("<think>a</think>", False), ("", False), (None, False), ("<think></think><answer></answer>" + "x" * 5000, False)]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, c string")
    assert [r[1] for r in rows(df.select("k", rewards.format_ok(F.col("c"))), "k")] == [w for _, w in cases]


def test_reconstructed(spark):
    df = spark.createDataFrame([(1, " a "), (2, "<think>x"), (3, ""), (4, None)], "k int, c string")
    assert [r[1] for r in rows(df.select("k", rewards.reconstructed(F.col("c"))), "k")] == ["<think>\na", "<think>x", "", ""]


def test_jury(spark):
    df = spark.createDataFrame([("a", "x", 0.92), ("a", "y", 0.90), ("a", "z", 0.88), ("b", "x", 0.98), ("b", "y", 0.40), ("b", "z", 0.35), ("c", "x", 1.7)], "item string, judge string, score double")
    got = {r.item: r for r in rewards.jury(df, "item", "judge", "score").collect()}
    assert abs(got["a"]["mean"] - 0.9) < 1e-9 and not got["a"].controversial and got["a"].reward > 0.8
    assert got["b"].controversial and got["b"].reward < 0.15
    assert got["c"]["mean"] == 1.0 and got["c"].judges == {"x": 1.7} and got["c"]["std"] == 0.0


def test_consensus(spark):
    df = spark.createDataFrame([("g", 0, "x. Breach of contract."), ("g", 1, "<answer>breach of contract</answer>"), ("g", 2, "other"), ("g", 3, "y. breach of contract"), ("h", 5, "b"), ("h", 4, "a"), ("h", 9, None)], "g string, k int, c string")
    got = {r.group: r for r in rewards.consensus(df, "g", "k", "c").collect()}
    assert (got["g"].winner, got["g"].ratio, got["g"].agreed, got["g"].n) == ("breach of contract", 0.75, True, 3)
    assert got["h"].winner == "a" and not got["h"].agreed


def test_cycle_and_fluency(spark):
    df = spark.createDataFrame([("the cat sat", "cat sat"), ("", ""), ("", "x"), ("a", "")], "a string, b string")
    assert [round(r[0], 3) for r in df.select(rewards.cycle_overlap(F.col("a"), F.col("b"))).collect()] == [0.667, 1.0, 0.0, 0.0]
    t = spark.createDataFrame([("The report was signed by the board and it is in the archive of the town.",), ("gpu. fast. cheap. cool.",), ("",)], "t string")
    p = [r[0] for r in t.select(rewards.perplexity_estimate(F.col("t"))).collect()]
    assert p[0] == 9.0 and p[1] > 30 and p[2] == 100.0
    assert [r[0] for r in t.select(rewards.fluency_penalty(rewards.perplexity_estimate(F.col("t")))).collect()][0] == 0.0


def test_advantages(spark):
    data = [("b1", "g1", 1, 0.0), ("b1", "g1", 2, 0.0), ("b1", "g2", 3, 1.0), ("b1", "g2", 4, 1.0), ("b2", "g1", 5, 1.0), ("b2", "g1", 6, 3.0), ("b3", "g1", 7, 2.0)]
    df = spark.createDataFrame(data, "batch string, grp string, k int, reward double")
    got = {r.k: (round(r.advantage, 4), r["mode"]) for r in grpo.advantages(df, "batch", "grp", "reward").collect()}
    assert got[1] == (-1.0, "batch_fallback") and got[4] == (1.0, "batch_fallback") and got[5] == (-1.0, "intra_group") and got[7] == (0.0, "zero_fallback")


def test_streaks_and_anchor(spark):
    b = spark.createDataFrame([("r", k, s) for k, s in enumerate([0.0, 0.0, 0.0, 0.0, 1.0, 0.0])], "run string, step int, std double")
    assert [r.streak for r in grpo.flat_streaks(b, "run", "step", "std").orderBy("step").collect()] == [1, 2, 3, 4, 0, 1]
    assert rows(grpo.anchored_batches(b, "run", "step", "std").select("step"), "step") == [(2,), (3,)]
    df = spark.createDataFrame([(1, g, k, c, 0.0) for g, k, c in [(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "G"), (2, 0, "a"), (2, 1, "x")]], "batch int, grp int, k int, completion string, reward double")
    out = grpo.with_anchor(df, spark.createDataFrame([(1,)], "batch int"), "batch", "grp", "k", "completion", "reward", "G", 1.5)
    got = rows(out.select("grp", "k", "completion", "reward", "anchored"), "grp", "k")
    assert got == [(0, 0, "a", 0.0, True), (0, 1, "G", 1.5, True), (1, 0, "a", 0.0, True), (1, 1, "G", 0.0, True), (2, 0, "a", 0.0, False), (2, 1, "x", 0.0, False)]


def test_group_sizes(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "b int, g int")
    with pytest.raises(ValueError):
        grpo.checked(df, "b", "g", 2)
    assert grpo.checked(df.where("g = 1"), "b", "g", 2).count() == 2


def test_phase_change(spark):
    data = [("r", k, 0.9, 0.3) for k in range(1, 6)] + [("r", k, 0.5, 0.5) for k in range(6, 11)]
    got = M.phase_changes(spark.createDataFrame(data, "run string, step int, format_reward double, accuracy_reward double"), "run", "step").orderBy("step").collect()
    assert [r.alert for r in got] == [False] * 9 + [True] and got[8].format_delta is None


def test_diversity(spark):
    df = spark.createDataFrame([("a", "the same old words"), ("a", "the same old words")] * 4 + [("b", "x"), ("b", None), ("c", "a b"), ("c", "b a")], "g string, c string")
    got = {r.group: r for r in M.diversity(df, "g", "c").collect()}
    assert got["a"].ratio == 0.125 and got["a"].collapsed and got["b"].ratio == 0.0 and got["b"].collapsed and got["c"].ratio == 1.0


def test_governor(spark):
    df = spark.createDataFrame([("r", k + 1, x) for k, x in enumerate([0.85, 0.80, 0.10, 0.12, 0.08, 0.65])], "run string, step int, ratio double")
    got = M.governed(df, "run", "step", "ratio", after=3).orderBy("step").collect()
    assert [r.action for r in got] == ["nominal"] * 4 + ["started", "recovered"] and got[4].temperature == 1.15 and got[5].temperature == 0.7


def test_validation(spark):
    df = spark.createDataFrame([("r", s, a) for s, a in [(100, 0.40), (200, 0.402), (250, 0.9), (300, 0.401), (400, 0.39)]], "run string, step int, acc double")
    got = M.validated(df, "run", "step", "acc", interval=100, patience=300, gain=0.01).orderBy("step").collect()
    assert [(r.step, r.is_best, r.stop) for r in got] == [(100, True, False), (200, False, False), (300, False, False), (400, False, True)]


def test_pareto(spark):
    df = spark.createDataFrame([("r", 1, 0.4, 0.9), ("r", 2, 0.5, 0.8), ("r", 3, 0.45, 0.95), ("z", 1, 0.0, 0.0)], "run string, step int, acc double, fmt double")
    got = rows(M.pareto_classes(df, "run", "step", "acc", "fmt").select("run", "step", "best_accuracy", "best_format", "balanced"), "run", "step")
    assert got == [("r", 1, True, True, True), ("r", 2, True, False, True), ("r", 3, False, True, False), ("z", 1, False, False, False)]
    c = rows(M.checkpoints(df, "run", "step", "acc", "fmt"), "run", "class")
    assert c == [("r", "balanced_pareto", 2), ("r", "best_accuracy", 2), ("r", "best_format", 3), ("r", "latest", 3), ("z", "latest", 1)]


def test_contention(spark):
    df = spark.createDataFrame([(500.0, False), (5000.0, True)], "ms double, tiered boolean")
    a, b = (r[0] for r in df.select(M.scrape_contention(F.col("ms"), F.col("tiered"))).collect())
    assert (a.scrapes, a.lock_pct, a.p99_ms, a.safe) == (80000.0, 18.5, 350.0, False)
    assert b.p99_ms == 45.0 and b.reduction_pct > 85 and b.safe


def test_log_faults(spark):
    lines = ["NVRM: Xid (PCI:0000:01:00): 31, pid=1", "x NVRM: Xid (PCI:0000:02:00): 45, ecc", "NVRM: Xid (PCI:0000:01:00): 13, graphics", "usb 1-1: new device", None]
    got = M.log_faults(spark.createDataFrame([(x,) for x in lines], "line string"), "line").collect()
    assert [(r.code, r.fatal, r.pci) for r in got] == [(31, True, "0000:01:00"), (45, True, "0000:02:00"), (13, False, "0000:01:00")] and [r.taint for r in got] == [M.TAINT, M.TAINT, M.NO_TAINT]


def test_alerts(spark):
    df = spark.createDataFrame([("k", f"2024-01-01 00:0{m}:00", v) for m, v in enumerate([1, 9, 9, 9, 1, 9, None])], "k string, t string, v int").selectExpr("k", "cast(t as timestamp) as ts", "v")
    got = M.sustained(df, ["k"], "ts", "v", 5, 120).collect()
    assert len(got) == 1 and str(got[0].began) == "2024-01-01 00:01:00" and str(got[0].fired) == "2024-01-01 00:03:00"
    r = M.counter_rates(df.selectExpr("k", "ts", "cast(v as double) as v"), ["k"], "ts", "v", 300).collect()
    assert sum(x.rate for x in r) * 300 == 8 + 8


def test_spells_over_chunks(spark):
    import random

    rng = random.Random(3)
    data, want = [], set()
    for k in ("a", "b"):
        t, spell = 0, []
        for _ in range(400):
            t += rng.randint(1, 40)
            v = rng.choice([1, 9, 9, 9, None])
            data.append((k, t, v))
            if v == 9:
                spell.append(t)
            else:
                if spell and spell[-1] - spell[0] >= 60:
                    want.add((k, spell[0]))
                spell = []
        if spell and spell[-1] - spell[0] >= 60:
            want.add((k, spell[0]))
    df = spark.createDataFrame(data, "k string, t int, v int").select("k", F.timestamp_seconds("t").alias("ts"), "v")
    for chunk in (7, 100, 100_000):
        got = M.sustained(df, ["k"], "ts", "v", 5, 60, chunk).select("k", F.unix_seconds("began").cast("int"))
        assert set(rows(got)) == want


def test_histogram_quantile(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 10), ("a", float("inf"), 10), ("b", 1.0, 0), ("b", float("inf"), 4), ("c", 1.0, 0), ("c", float("inf"), 0)], "k string, le double, count long")
    assert rows(M.histogram_quantile(df, ["k"], 0.75), "k") == [("a", 1.5), ("b", 1.0)]


def test_scaler(spark):
    df = spark.createDataFrame([("p", float(t), w) for t, w in [(0, 0.0), (15, 12.0), (30, 1.0), (200, 1.0), (331, 1.0)]], "pool string, at double, waiting double")
    assert [r.replicas for r in M.scaled(df, "pool", "at", "waiting").orderBy("at").collect()] == [1, 3, 3, 3, 1]


def test_latest_metrics(spark):
    df = spark.createDataFrame([(1, "DCGM_FI_DEV_GPU_UTIL", 1, 5.0), (1, "DCGM_FI_DEV_GPU_UTIL", 2, 6.0), (1, "other", 3, 1.0)], "gpu int, metric string, ts int, value double")
    assert M.latest_metrics(df, "gpu").first().metrics == {"DCGM_FI_DEV_GPU_UTIL": 6.0}


def test_tagged_texts_count_in_queries(spark, tmp_path):
    from millrace.plans import registry

    data = [(1, "s", "so <answer> 7 of 9 </answer> 3"), (2, "s", "Well. 7 of 9."), (3, "s", "other 4."), (4, "s", None)]
    spark.createDataFrame(data, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, question string, target string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert rows(registry.queries()["r10_last_number"](spark, str(tmp_path)), "k") == [(1, "9"), (2, "9"), (3, "4")]
    r = registry.queries()["r14_consensus"](spark, str(tmp_path)).first()
    assert (r.winner, r.n, r.total, r.agreed) == ("7 of 9", 2, 3, True)
    assert rows(registry.queries()["r14_members"](spark, str(tmp_path)), "k") == [("s", 1), ("s", 2)]


def test_jury_with_repeated_and_unnamed_judges(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.7), (1, None, 0.6), (1, "b", None), (2, "a", 3.0)], "item int, judge string, score double")
    one, two = rewards.jury(df, "item", "judge", "score").orderBy("item").collect()
    assert one.judges == {"a": 0.6} and round(one["mean"], 9) == 0.6 and two.judges == {"a": 3.0} and two["mean"] == 1.0


def test_duplicates_differ_by_outer_space(spark, tmp_path):
    from millrace.plans import registry

    data = [(1, "Why?"), (2, " why? "), (3, "x"), (4, "X\n"), (5, " "), (6, None), (7, "two\nlines"), (8, "\u3000Two\nlines")]
    spark.createDataFrame(data, "example_id long, prompt string").write.parquet(f"{tmp_path}/sft_examples.parquet")
    assert rows(registry.queries()["j5_duplicates"](spark, str(tmp_path)), "example_id") == [(1, False), (2, True), (3, False), (4, True), (7, False), (8, True)]
