from pyspark.sql import functions as F

from millrace.operators import dpo, sft
from tests.conftest import rows


def test_extracts_all_shapes(spark):
    df = spark.createDataFrame(
        [
            (0, [("user", "hi"), ("assistant", "yo"), ("user", "again")], None, None, None),
            (1, [("assistant", "yo")], "ignored", None, None),
            (2, None, "", " q ", "a"),
            (3, None, "  ", None, "a"),
            (4, None, None, None, None),
        ],
        "ordinal int, messages array<struct<role:string,content:string>>, prompt string, question string, answer string",
    )
    got = rows(sft.extracted(df).select("ordinal", "p", "c", "valid", "error"), "ordinal")
    assert got == [(0, "hi\nagain", "yo", True, None), (1, "", "yo", False, "Missing user prompt in messages"), (2, "q", "a", True, None), (3, "", "a", False, "Empty or missing prompt"), (4, "", "", False, "Empty or missing prompt")]


def test_report_of_broken_rows(spark):
    df = spark.createDataFrame([(1, "p one", "answer"), (2, "P ONE ", "other"), (3, "p two", ""), (4, None, "x"), (5, "p" * 400, "y" * 400)], "ordinal int, prompt string, completion string")
    r = sft.report(df, max_len=120, invalid_json=1).first()
    assert (r.total, r.invalid, r.empty, r.truncated, r.over_length, r.duplicates, r.valid) == (6, 2, 1, 1, 1, 1, 3)
    assert r.gate == "Validation Alerts Detected" and not sft.passes_strict(r.asDict())


def test_report_of_clean_and_empty(spark):
    df = spark.createDataFrame([(1, "one", "a"), (2, "two", "b")], "ordinal int, prompt string, completion string")
    r = sft.report(df).first()
    assert r.gate == "Clean Execution" and sft.passes_strict(r.asDict()) and r.padded == r.useful
    e = sft.report(df.where("false")).first()
    assert e.total == 0 and e.mean is None and e.padded == 0 and e.waste_pct == 0.0


def test_unknown_tokenizer_is_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        sft.featurised(spark.createDataFrame([("a", "b")], "p string, c string"), tokens="missing")


def test_labels_and_misalignment(spark):
    df = spark.createDataFrame([(1, [-100, -100, 5]), (2, [1, -100, 5]), (3, [1, 2, 3]), (4, [-100, -100, -100]), (5, []), (6, None)], "k int, labels array<int>")
    got = dict(rows(df.select("k", sft.misaligned(F.col("labels"), F.lit(2), F.lit(False)))))
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False, 6: False}
    ids = spark.createDataFrame([([1, 2, 3],)], "ids array<int>")
    assert ids.select(sft.answer_labels(F.col("ids"), F.lit(2))).first()[0] == [-100, -100, 3]


def test_collation(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [1, 2, 3]), (0, [4], [-100])], "b int, ids array<int>, labels array<int>")
    got = sorted(rows(sft.collated(df, "b", "ids", "labels").select("padded_ids", "mask", "padded_labels", "useful", "padded")))
    assert got == [([1, 2, 3], [1, 1, 1], [1, 2, 3], 4, 6), ([4, 0, 0], [1, 0, 0], [-100, -100, -100], 4, 6)]


def test_dense_ordinal_spans_parts(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7 % 1000).alias("x"), F.lit(1).alias("ordinal_"))
    got = rows(sft.dense_ordinal(df, "x").select("x", "ordinal"), "x")
    assert got == [(k, k) for k in range(1000)]


def test_batch_faults(spark):
    good = ([1, 5, 6, 7, 2, 0], [-100, -100, -100, 7, 2, -100])
    cases = [(good[0], good[1], None), (good[0], [-100] * 6, "nothing supervised"), (good[0], [-100, 5, 6, 7, 2, -100], "prompt supervised"), (good[0], [-100, -100, -100, 7, 2, 0], "padding supervised"), (good[0], [-100, -100, -100, 8, 2, -100], "label differs from token"), ([9, 5, 6, 7, 2, 0], good[1], "delimiter missing"), (good[0], [-100, -100, -100, -100, 2, -100], "only the end supervised")]
    df = spark.createDataFrame([(k, i, y, 3, 5) for k, (i, y, _) in enumerate(cases)], "k int, ids array<int>, labels array<int>, prompt_len int, used int")
    assert [r[1] for r in rows(sft.batch_faults(df).select("k", "fault"), "k")] == [w for *_, w in cases]


def test_reconciled(spark):
    a = spark.createDataFrame([(1, [1, 2]), (2, [1]), (3, [9]), (5, [])], "k int, ids array<int>")
    b = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [1]), (4, [1]), (5, [])], "k int, ids array<int>")
    assert dict(rows(sft.reconciled(a, b, "k"))) == {1: "same", 2: "without last", 3: "different", 4: "missing", 5: "same"}


PAIR = "prompt string, chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>, score_chosen double, score_rejected double"


def chat(p, a):
    return [("user", p), ("assistant", a)]


def test_pair_report(spark):
    long = " ".join(f"w{k}" for k in range(40))
    data = [
        ("p1", chat("p1", "same"), chat("p1", "Same "), 5.0, 4.0),
        ("p2", chat("p2", long + " x"), chat("p2", long + " y"), 5.0, 4.0),
        ("p3", chat("p3", "good"), chat("p3", "bad thing"), 1.0, 4.0),
        ("p4", chat("other", "good"), chat("p4", "bad thing"), 5.0, 4.0),
        ("p5", None, chat("p5", "b"), 5.0, 4.0),
        ("p6", chat("p6", "good"), chat("p6", "bad thing"), 4.0, 4.0),
        ("p6", chat("p6", "good"), chat("p6", "bad thing"), float("nan"), 4.0),
        (None, chat("x", "good"), chat("x", "bad thing"), None, None),
    ]
    r = dpo.report(spark.createDataFrame(data, PAIR)).first()
    assert (r.total, r.valid, r.empty_pairs, r.mismatched, r.identical, r.near_identical, r.reversed, r.tied, r.duplicates) == (8, 6, 2, 1, 1, 1, 1, 1, 1)
    assert r.gate == "Defects Detected"


def test_pair_report_of_bias_and_nothing(spark):
    biased = spark.createDataFrame([("p", "a " * 100, "b c", 2.0, 1.0)], "prompt string, chosen string, rejected string, score_chosen double, score_rejected double")
    assert dpo.report(biased).first().gate == "Quality Warnings"
    assert dpo.report(biased.where("false")).first().gate == "Invalid Dataset"


def test_score_names(spark):
    df = spark.createDataFrame([("p", "a", "b", "3", "x")], "prompt string, chosen string, rejected string, chosen_score string, rejected_rating string")
    assert df.select(dpo.score(df, "chosen"), dpo.score(df, "rejected")).first()[:] == (3.0, None)


def test_whole_profile(spark):
    data = [
        ("p1", chat("p1", "a b c d " * 2000), chat("p1", "other words " * 10), 5.0, 4.0),
        ("p2", [("assistant", "p2"), ("assistant", "good")], chat("p2", "Good "), 2.0, 3.0),
        ("p3", chat("p3", "x"), [("user", "else"), ("user", "y")], 4.0, 4.0),
        ("p4", chat(" p4 ", "x"), chat("p4", "y"), None, 4.0),
        ("p5", chat("p5", "x"), chat("p5", "y"), float("nan"), 4.0),
        ("", None, None, 9.0, 1.0), (None, None, None, 9.0, 1.0), ("p6", [("user", "p6")], None, 9.0, 1.0), ("p7", chat("p7", "x"), None, 9.0, 1.0),
    ]
    r = dpo.whole_profile(spark.createDataFrame(data, PAIR)).first()
    assert (r.total, r.complete, r.missing_prompt, r.missing_chosen, r.missing_rejected, r.missing_scores) == (9, 5, 2, 1, 1, 2)
    assert (r.chosen_role_mismatch, r.rejected_role_mismatch, r.chosen_prompt_mismatch, r.rejected_prompt_mismatch) == (1, 1, 0, 1)
    assert (r.score_chosen_min, r.score_chosen_max, r.score_rejected_mean, r.margin_min, r.reversed, r.tied, r.positive) == (2.0, 5.0, 11 / 3, -1.0, 1, 1, 1)
    assert (r.chosen_len_max, r.chosen_len_cut_max, r.rejected_len_cut_max, r.delta_len_max, r.delta_len_cut_max, r.delta_len_min) == (3999.0, 1024.0, 29.0, 3970.0, 995.0, 0.0)
    assert (r.chosen_over, r.chosen_total_over, r.any_over, r.prompt_over, r.identical, r.chosen_twice, r.rejected_twice) == (1, 1, 1, 0, 1, 1, 0)
    assert abs(r.clean_pct - 100 / 9 * (9 - 9)) < 1e-9
    e = dpo.whole_profile(spark.createDataFrame(data, PAIR).where("false")).first()
    assert e.total == 0 and e.margin_mean is None and e.clean_pct is None


def test_whole_profile_of_plain_sides(spark):
    df = spark.createDataFrame([("p", "a b", "a b c d e", 2.0, 1.0), ("q", "", "b", 2.0, 1.0)], "prompt string, chosen string, rejected string, score_chosen double, score_rejected double")
    r = dpo.whole_profile(df).first()
    assert (r.complete, r.missing_chosen, r.chosen_role_mismatch, r.similarity_mean, r.margin_mean) == (1, 1, 0, 0.4, 1.0)


def test_positional_fallback(spark):
    df = spark.createDataFrame([("p", [("x", "p"), ("y", "answer")], [("x", "p")], None, None)], PAIR)
    assert dpo.sides(df).select("chosen_text", "rejected_text", "missing").first()[:] == ("answer", "", True)


def test_truncation_and_stack(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], [4, 5], [6]), (2, [7], [8], [9])], "k int, prompt_ids array<int>, chosen_ids array<int>, rejected_ids array<int>")
    cut = dpo.trainer_rows(df, 99, 2, 2)
    assert rows(cut.select("prompt_ids", "chosen_ids", "rejected_ids"), "k") == [([2, 3], [4, 5], [6, 99]), ([7], [8, 99], [9, 99])]
    c = dpo.collated(cut.withColumn("b", F.lit(0)), "b")
    assert rows(c.select("prompt_ids"), "k") == [([2, 3],), ([0, 7],)]
    s = rows(dpo.stacked(cut, "k").where("k = 1").select("side", "ids", "loss_mask"), "side")
    assert s == [("chosen", [2, 3, 4, 5], [0, 0, 1, 1]), ("rejected", [2, 3, 6, 99], [0, 0, 1, 1])]


def test_margins(spark):
    df = spark.createDataFrame([(0, -1.0, -2.0, -1.0, -1.0), (1, -3.0, -1.0, -1.0, -2.0), (2, -1.0, -1.0, -1.0, -1.0)], "idx int, pi_chosen double, pi_rejected double, ref_chosen double, ref_rejected double")
    m = dpo.implicit_rewards(df)
    p = dpo.population(m).first()
    assert (p.positive, p.zero, p.negative, p.lower_median, p.likelihood_wins) == (1, 1, 1, 0.0, 1) and abs(p.accuracy - 1 / 3) < 1e-12
    b = dpo.batch_mean_accuracy(m, "idx").first()
    assert (b.batches, b.batch_accuracy) == (2, 0.25)
