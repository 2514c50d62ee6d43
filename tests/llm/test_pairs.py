import bisect
import os

import pytest
from pyspark.sql import functions as F

from millrace.llm import language, pairs
from tests.conftest import rows
from tests.llm import held_out

LONG_DE = "Die Grenze liegt bei zwei Anfragen pro Sekunde, weil der Verteiler nicht schneller ist."
LONG_EN = "The limit is two requests per second, because the router is not faster than that."


@pytest.mark.parametrize("text", [None, "", " \t\n", "​", "...", "-", '""', "N/A", "n/a", "None", "null", "[empty]", "(no answer)", "<p></p>", "<br/>&nbsp;"[:5], "TBD", "\xa0 "])
def test_empty(text):
    assert pairs.is_empty(text)


@pytest.mark.parametrize("text", ["No", "Yes", "0", "Rarely", "batch=4", "nothing changed", "<p>42</p>"])
def test_not_empty(text):
    assert not pairs.is_empty(text)


def test_copies():
    p = "The queue was full. Why did the worker stop?"
    assert pairs.is_copy(p, p) and pairs.is_copy(p, "Q: why did the worker stop?") and pairs.is_copy(p, "> " + p.upper()) and pairs.is_copy(p, "The\nqueue was full")
    assert not pairs.is_copy(p, "Why did the worker stop? It ran out of memory.") and not pairs.is_copy(p, "queue was full. Why did") and not pairs.is_copy(p, "full")
    assert not pairs.is_copy("Fix the spelling. At 1.86 the queue was full.", "At 18.6 the queue was full.")


@pytest.mark.parametrize("text", ["I can't help with that.", "I'm sorry. I have to decline. Is there anything else I can do for you?", "Leider darf ich diese Frage nicht beantworten.", "Das muss ich ablehnen. Ich hoffe auf dein Verständnis.", "Je ne peux pas vous aider.", "il m’est impossible de répondre à cette demande", "Lo siento. No puedo ayudar con eso.", "This request can’t be fulfilled!", "I won't comment about the queue, it goes against my guidelines."])
def test_refusals(text):
    assert pairs.is_refusal("Why does the queue grow?", text)


@pytest.mark.parametrize("text", ["I can't see your cluster from here, but this pattern is well known. The queue grew by 40 percent, because the worker was slow.", "You cannot avoid this entirely. Keep the queue short.", "Sorry for the long reply. The queue grew.", LONG_EN])
def test_no_refusals(text):
    assert not pairs.is_refusal("Why does the queue grow?", text)


LONG_REFUSAL = "I'm sorry, but I can't help with this request. I know that this is not what you hoped to hear, and I have thought about whether some part of it could be answered without crossing the line that I was given. I have no way to see who is asking or what the answer would be used for, and a careless reply could do harm to people who never agreed to any of it. Please talk to someone qualified who knows the whole situation and can take responsibility for it. If you like, we can talk about another topic instead, and I hope you understand."
LONG_ANSWER = "I'm not able to give advice about one cluster in particular. The queue usually grows because requests arrive faster than the worker can take them, and then every retry adds to the pile. Look at the arrival rate first and compare it with the rate of the worker over the same hour. If the worker is slower, add another one or shed part of the load before it reaches the queue. If both rates agree, a stuck request holds the others back and a restart of the worker clears it at once."


@pytest.mark.parametrize("text", [LONG_REFUSAL, "I can't help with that. You can call the support desk at 555-0142.", "I'm not able to answer this. Please ask again after 12 May 2026.", "I can't help with that. The office opens again on 3 May 2026.", "Leider darf ich diese Frage nicht beantworten. Bitte wenden Sie sich an die Beratungsstelle unter 030 1234567."])
def test_refusals_of_any_length_and_with_figures(text):
    assert pairs.is_refusal("Why does the queue grow?", text)


@pytest.mark.parametrize("text", [LONG_ANSWER, "I can't comment on your cluster. The queue grew by 40 percent, because the worker was slow.", "I can't give advice on your cluster, but the queue grew by 40 percent.", "I would rather not guess. It was 40 percent."])
def test_declines_and_still_answers(text):
    assert pairs.REFUSALS.search(text) and not pairs.is_refusal("Why does the queue grow?", text)


def test_a_date_that_was_asked_for_answers():
    assert not pairs.is_refusal("When did it start?", "I can't answer for others. It was on 3 May 2026.")


def test_asked_to_decline():
    assert not pairs.is_refusal("Draft a short refusal to a vendor.", "Dear colleague, I am not able to help this time. Kind regards.")


def test_languages():
    assert language.language(LONG_DE) == "de" and language.language(LONG_EN) == "en" and language.language("42") is None
    assert pairs.Rules().is_foreign(LONG_EN, LONG_DE) and not pairs.Rules().is_foreign(LONG_EN + " Answer in German please.", LONG_DE) and not pairs.Rules().is_foreign(LONG_DE, LONG_DE) and not pairs.Rules().is_foreign(LONG_EN, "No")


def test_shortened(spark):
    texts = ["a", "ab", "ab", "abc", "b", "bcd", "c", "zz" * 10_000, "zz" * 10_000 + "y", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    keys = {r.key for r in pairs.shortened(df).collect()}
    import hashlib

    assert keys == {hashlib.md5(t.encode()).hexdigest() for t in ("", "a", "ab", "b", "zz" * 10_000)}
    assert pairs.shortened(df.where("false")).count() == 0


def test_shortened_but_for_marks_and_spaces(spark):
    texts = [(1, "The queue grew because..."), (2, "The queue grew because the worker was slow."), (3, "The queue grew \n"), (4, "The queue grew because…"), (5, "The queue grew because the worker was slow. "), (6, None), (None, "The")]
    df = spark.createDataFrame(texts, "record_id long, text string").repartition(3)
    assert rows(pairs.shortened_ids(df), "record_id") == [(1, True), (3, True), (4, True)]


def test_defects(spark):
    from tests.llm.test_truncation import corpus

    data = [(k, "What did the scheduler do before the release?", t, s) for k, s, t, c in corpus(600, 9) if not c]
    p = "What did the scheduler do before the release?"
    odd = [(p, None, "empty"), (p, "N/A", "empty"), (p, p, "copy"), (p, "I cannot assist with this request.", "refusal"), (p, LONG_DE, "language"), (p, data[0][2][: len(data[0][2]) // 2].rstrip(". ") + " an", "truncated"), (None, None, None), ("  ", "", None), (p, LONG_EN, None)]
    rows_ = data + [(10_000 + k, a, b, "a") for k, (a, b, _) in enumerate(odd)]
    df = spark.createDataFrame(rows_, "example_id long, prompt string, completion string, source string").withColumn("rule", F.lit("clash"))
    got = dict(rows(pairs.defects(df)))
    assert {k: v for k, v in got.items() if k >= 10_000} == {10_000 + k: w for k, (_, _, w) in enumerate(odd) if w}
    assert len(got) < 20
    assert pairs.defects(df.where("false")).count() == 0


MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    examples = spark.read.parquet(f"{MEDIUM}/sft_examples.parquet").where("completion is not null and length(trim(prompt)) > 0")
    return pairs.Rules.fitted(spark, examples.select("prompt", "completion").toPandas())


@pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="no test tables here")
def test_refusals_in_other_words(fitted):
    """Of paraphrases, and of answers that only look like refusals, that none of the lists was made from."""
    found = [pairs.is_refusal(p, c) for p, c in held_out.REFUSALS]
    assert sum(found) < 5  # the phrases alone don't know them
    hit = sum(fitted.is_refusal(p, c) for p, c in held_out.REFUSALS)
    wrong = sum(fitted.is_refusal(p, c) for p, c in held_out.ANSWERS)
    assert hit >= 0.9 * len(held_out.REFUSALS) and hit >= 0.9 * (hit + wrong)


@pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="no test tables here")
def test_languages_without_lists(fitted):
    hit = sum(fitted.is_foreign(p, c) for p, c in held_out.FOREIGN)
    wrong = sum(fitted.is_foreign(p, c) for p, c in held_out.NATIVE)
    assert hit >= 0.9 * len(held_out.FOREIGN) and hit >= 0.9 * (hit + wrong)


def test_scripts():
    assert language.script("缓存在夜间") == "CJK" and language.script("キューを確認") == "KANA" and language.script("Почему?") == "CYRILLIC" and language.script("Why 42?") == "LATIN"
    assert language.script("42 !") is None and language.script("ab缓存") is None and language.script("") is None


def test_names_of_languages(spark):
    names = pairs.language_names(spark)
    assert names["chinese"] == "zh" and names["russisch"] == "ru" and names["italien"] == "it" and names["german"] == "de" and names["portugués"] == "pt"


def test_no_seeds_and_nothing_to_fit(spark):
    rules = pairs.Rules.fitted(spark, __import__("pandas").DataFrame({"prompt": ["Why?"], "completion": ["So."]}))
    assert rules.of("Why?", "I won't say that.") is None and rules.of("Why?", "") == "empty"
    assert pairs.Rules.fitted(spark, __import__("pandas").DataFrame({"prompt": [], "completion": []})).of("Why?", "So.") is None


def test_one_answer_of_a_third_of_all_rows(spark):
    df = spark.range(9000).select(F.col("id").alias("record_id"), F.when(F.col("id") % 3 == 0, "None of it").otherwise(F.concat(F.lit("None of it was so, said "), F.col("id").cast("string"))).alias("text"))
    got = {r.record_id for r in pairs.shortened_ids(df).collect()}
    texts = sorted(f"None of it was so, said {k}" for k in range(9000) if k % 3)
    want = {k for k in range(0, 9000, 3)} | {k for k in range(9000) if k % 3 and any(t.startswith(own) and t != own for own in [f"None of it was so, said {k}"] for t in texts[bisect.bisect(texts, own) : bisect.bisect(texts, own) + 1])}
    assert got == want
