"""Rewards from texts: R4 to R17."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numeric import MAX_TEXT, accuracy, answer_text
from millrace.functions.text import normal_key, py_strip, words

# Words that hold an English sentence together.
FUNCTION_WORDS = "the a an in on at to for with by of and but or is was are were been it this that from as into reported under despite which".split()


def format_ok(c: Column) -> Column:
    """Closed think tags and closed answer tags, thinking first; an answer inside the thinking passes. Null, empty and very long texts fail."""
    think, answer = F.regexp_instr(c, F.lit(r"(?s)<think>.*?</think>")), F.regexp_instr(c, F.lit(r"(?s)<answer>.*?</answer>"))
    return F.coalesce(F.length(c).between(1, MAX_TEXT) & (think > 0) & (answer > 0) & (think < answer), F.lit(False))


def reconstructed(c: Column) -> Column:
    """A continuation with the opening tag that its prompt already held."""
    s = py_strip(F.coalesce(c, F.lit("")))
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(s.startswith("<think>"), s).otherwise(F.concat(F.lit("<think>\n"), s))


def thinking(c: Column) -> Column:
    """The first thinking text, '' if there is none."""
    return py_strip(F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1))


def rewarded(df: DataFrame, completion: str, target: str, format_weight: float = 0.5, accuracy_weight: float = 1.0) -> DataFrame:
    """Adds answer, thought, format_valid, accurate, reward. The exact comparison is the only part outside the JVM."""
    c = F.col(completion)
    df = df.withColumns({"answer": answer_text(c), "thought": thinking(c), "format_valid": format_ok(c), "accurate": accuracy(c, F.col(target))})
    return df.withColumn("reward", F.when(F.col("format_valid"), format_weight).otherwise(0.0) + F.when(F.col("accurate"), accuracy_weight).otherwise(0.0))


def last_number(c: Column) -> Column:
    """The last plain number of the answer tag's content, else of the text; null if there is none."""
    inside = F.regexp_extract(c, r"(?s)<answer>(.*?)</answer>", 1)
    return F.try_element_at(F.regexp_extract_all(F.when(inside != "", inside).otherwise(c), F.lit(r"[-+]?\d*\.\d+|\d+"), F.lit(0)), F.lit(-1))


def jury(scores: DataFrame, item: str, judge: str, score: str, doubt: float = 2.0, controversial: float = 0.2) -> DataFrame:
    """Item, mean, std, reward, controversial, judges: scores clamped to 0..1, reward max(0, mean - doubt * population deviation); judges maps to the scores as given.

    A judge that scored an item several times counts once, with the mean of its scores. Null scores don't count; a null judge counts, but isn't in the map."""
    scores = scores.where(F.col(score).isNotNull()).groupBy(item, judge).agg(F.avg(score).alias("_score"))
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_score")))
    named = F.when(F.col(judge).isNotNull(), F.struct(F.col(judge).alias("key"), F.col("_score").alias("value")))
    out = scores.groupBy(item).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.map_from_entries(F.array_sort(F.collect_list(named))).alias("judges"))
    return out.withColumns({"reward": F.greatest(F.lit(0.0), F.col("mean") - doubt * F.col("std")), "controversial": F.col("std") >= controversial})


def conclusion(c: Column) -> Column:
    """The answer tag's content, else the last sentence by stops, in lower case."""
    tagged = F.regexp_extract(c, r"(?s)<answer>(.*?)</answer>", 1)
    parts = F.filter(F.transform(F.split(py_strip(c), r"\."), py_strip), lambda s: s != "")
    return F.when(F.contains(c, F.lit("<answer>")) & F.rlike(c, F.lit(r"(?s)<answer>.*?</answer>")), normal_key(tagged)).otherwise(F.lower(F.coalesce(F.try_element_at(parts, F.lit(-1)), py_strip(c))))


def concluded(df: DataFrame, group: str, k: str, completion: str) -> DataFrame:
    """Group, k, conclusion of each completion that isn't null."""
    return df.where(F.col(completion).isNotNull()).select(F.col(group).alias("group"), F.col(k).alias("k"), conclusion(F.col(completion)).alias("conclusion"))


def consensus(df: DataFrame, group: str, k: str, completion: str, least: float = 0.6) -> DataFrame:
    """Group, winner, ratio, agreed, n, total: the most frequent conclusion, ties to the one seen first. Null completions are left out, a null group is a group.

    Conclusions are counted before groups meet, and a group's ranking is an aggregate with partial results, so a group of any size is split. Its members are consensus_members()."""
    counts = concluded(df, group, k, completion).groupBy("group", "conclusion").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
    best = F.min_by(F.struct("conclusion", "n"), F.struct(-F.col("n"), F.col("first"))).alias("best")
    of = counts.groupBy("group").agg(F.sum("n").alias("total"), best)
    ratio = F.col("best.n") / F.col("total")
    return of.select("group", F.col("best.conclusion").alias("winner"), ratio.alias("ratio"), (ratio >= least).alias("agreed"), F.col("best.n").alias("n"), "total")


def consensus_members(df: DataFrame, group: str, k: str, completion: str, least: float = 0.6) -> DataFrame:
    """Group, k of the completions that hold their group's winning conclusion, as rows, since a group may be of any size."""
    rows = concluded(df, group, k, completion).withColumnRenamed("group", "_group")
    won = consensus(df, group, k, completion, least).select("group", "winner")
    return rows.join(won, F.col("_group").eqNullSafe(F.col("group")) & (F.col("conclusion") == F.col("winner"))).select("group", "k")


def cycle_overlap(original: Column, rebuilt: Column) -> Column:
    """Share of the original's distinct words that the rebuilt text has; 1 if both have none, 0 if only the original has none."""
    a, b = F.array_distinct(words(original)), F.array_distinct(words(rebuilt))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.when(F.size(b) == 0, 1.0).otherwise(0.0))


def perplexity_estimate(c: Column) -> Column:
    """9, more where function words are rare or sentences short; 100 without words. Two digits."""
    w = words(c)
    n = F.size(w).cast("double")
    ratio = F.size(F.filter(w, lambda x: x.isin(*FUNCTION_WORDS))) / n
    sentences = F.size(F.filter(F.split(c, r"\."), lambda s: py_strip(s) != ""))
    mean = n / F.greatest(F.lit(1), sentences)
    return F.when(F.size(w) == 0, 100.0).otherwise(F.round(9.0 + F.when(ratio < 0.2, (0.2 - ratio) / 0.2 * 50).otherwise(0.0) + F.when(mean < 4, (4 - mean) / 4 * 30).otherwise(0.0), 2))


def fluency_penalty(ppl: Column, natural: float = 14.0, slope: float = 0.05, most: float = 2.0) -> Column:
    """R17."""
    return F.least(F.lit(most), slope * F.greatest(F.lit(0.0), ppl - natural))


def is_soup(ppl: Column, limit: float = 30.0) -> Column:
    return ppl > limit


def code_reward(passed: Column) -> Column:
    """R11 where tests have run elsewhere: 1 if they passed, 0 if not or unknown."""
    return F.when(passed, 1.0).otherwise(0.0)


def message_text(completion: Column, plain: Column | None = None) -> Column:
    """The first message's content, else the plain text."""
    first = F.get(completion, F.lit(0))["content"]
    return first if plain is None else F.coalesce(first, plain)
