"""Queries R1-R17 and G1-G10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import numeric
from millrace.operators import grpo, rewards
from millrace.plans import adapters as A
from millrace.plans.adapters import strip_sql
from millrace.plans.preflight import r6
from millrace.plans.registry import query
from millrace.session import table

# completions with tags, made of the held-out items: every kind of tagging occurs
_N = "split_part(target, '#### ', 2)"
_SHAPES = f"""case item_id % 8 when 0 then '<think>' || question || '</think> <answer>' || {_N} || '</answer>' when 1 then target when 2 then '<answer>' || {_N} || '</answer><think>x</think>'
  when 3 then question || ' the answer is ' || {_N} || ' ' when 4 then '<think>' || question || '<answer>7</answer>' when 5 then '<think>of 12</think> it comes to 1,234.5 or ' || {_N} || ' in all' when 6 then question else 'none' end"""
TAGGED = f"tagged as (select item_id, target, {_SHAPES} as c from eval_items)"


def tagged(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("question"), F.element_at(F.split("target", "#### "), 2)
    k = F.col("item_id") % 8
    c = (
        F.when(k == 0, F.concat(F.lit("<think>"), q, F.lit("</think> <answer>"), n, F.lit("</answer>"))).when(k == 1, F.col("target")).when(k == 2, F.concat(F.lit("<answer>"), n, F.lit("</answer><think>x</think>")))
        .when(k == 3, F.concat(q, F.lit(" the answer is "), n, F.lit(" "))).when(k == 4, F.concat(F.lit("<think>"), q, F.lit("<answer>7</answer>")))
        .when(k == 5, F.concat(F.lit("<think>of 12</think> it comes to 1,234.5 or "), n, F.lit(" in all"))).when(k == 6, q).otherwise(F.lit("none"))
    )
    return table(spark, d, "eval_items").select("item_id", "target", c.alias("c"))


_SAID = f"regexp_extract(c, '{numeric.PHRASE}', 1)"
_ANSWER = rf"""case when length(c) between 1 and {numeric.MAX_TEXT} then case when contains(c, '<answer>') or contains(c, '</answer>') then case when len(regexp_extract_all(c, '<answer>')) = 1 and len(regexp_extract_all(c, '</answer>')) = 1 and instr(c, '<answer>') < instr(c, '</answer>')
  then nullif({strip_sql("regexp_extract(c, '(?s)<answer>(.*?)</answer>', 1)")}, '') end when contains(c, '####') then regexp_extract(string_split(c, '####')[-1], '^\s*(\S+)', 1)
  when {_SAID} <> '' then {_SAID} else regexp_extract_all(string_split(c, '</think>')[-1], '{numeric.NUMBER}')[-1] end end"""


@query("r1_answers", f"with {TAGGED} select item_id, {_ANSWER} as answer from tagged")
def r1_answers(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).select("item_id", numeric.answer_text(F.col("c")).alias("answer"))


_FORMAT = r"coalesce(length(c) between 1 and 4096 and regexp_matches(c, '(?s)<think>.*?</think>') and regexp_matches(c, '(?s)<answer>.*?</answer>') and instr(c, regexp_extract(c, '(?s)<think>.*?</think>')) < instr(c, regexp_extract(c, '(?s)<answer>.*?</answer>')), false)"


_THOUGHT = strip_sql("regexp_extract(c, '(?s)<think>(.*?)</think>', 1)")


@query("r4_format", f"with {TAGGED} select item_id, {_FORMAT} as ok, case when {strip_sql('c')} like '<think>%' then {strip_sql('c')} else '<think>' || chr(10) || {strip_sql('c')} end as whole, {_THOUGHT} as thought from tagged")
def r4_format(spark: SparkSession, d: str) -> DataFrame:
    """R4, R5 and R7."""
    c = F.col("c")
    return tagged(spark, d).select("item_id", rewards.format_ok(c).alias("ok"), rewards.reconstructed(c).alias("whole"), rewards.thinking(c).alias("thought"))


@query("r6_rewards", f"with {TAGGED}, a as (select item_id, {_ANSWER} as a, split_part(target, '#### ', 2) as t, {_FORMAT} as ok from tagged) select item_id, ok as format_valid, coalesce(replace(a, ',', '')::double = replace(t, ',', '')::double, false) as accurate, case when ok then 0.5::double else 0 end + case when coalesce(replace(a, ',', '')::double = replace(t, ',', '')::double, false) then 1 else 0 end as reward from a")
def r6_rewards(spark: SparkSession, d: str) -> DataFrame:
    """R1-R7 with the exact comparison."""
    return rewards.rewarded(tagged(spark, d), "c", "target").select("item_id", "format_valid", "accurate", "reward")


@query(
    "r2_numbers",
    """with x as (select item_id, split_part(target, '#### ', 2) as text from eval_items), n as (select *, (replace(text, ',', '')::decimal(24, 6) * 1000000)::hugeint as n from x), g as (select *, gcd(n, 1000000::hugeint) as g from n)
select item_id, text, (n // g)::hugeint::varchar as num, (1000000 // g)::hugeint::varchar as den from g""",
)
def r2_numbers(spark: SparkSession, d: str) -> DataFrame:
    """R2 on the targets."""
    rows = table(spark, d, "eval_items").select("item_id", F.element_at(F.split("target", "#### "), 2).alias("text"))
    return rows.select("item_id", "text", numeric.exact_number_udf("text").alias("n")).select("item_id", "text", "n.num", "n.den")


# two ways to write a quantity, equal where t = u: fractions, percentages, grouped numbers, polynomials
_WAYS = """with w as (select l_orderkey, l_linenumber, l_quantity::bigint as q, l_linenumber::bigint as n, l_suppkey % 3 + 1 as t, l_partkey % 3 + 1 as u from lineitem)
select l_orderkey, l_linenumber, case (l_orderkey + n) % 4 when 0 then q || '/' || n when 1 then '$' || q || '%' when 2 then 'y = ' || format('{:,}', q * 1000 * t) else '(x + ' || t || ')^2' end as pred,
case (l_orderkey + n) % 4 when 0 then '\\frac{' || q * t || '}{' || n * u || '}' when 1 then q * t || ' / ' || 100 * u when 2 then q * 1000 * u || ' kg' else 'x^2 + ' || 2 * u || ' * x + ' || u * u end as target, t = u as same from w"""


@query("r8_equivalent", _WAYS)
def r8_equivalent(spark: SparkSession, d: str) -> DataFrame:
    """Two ways to write the quantity of each line, of which a third are equal; R9's pairs are in the tests."""
    n, q = F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long")
    w = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n"), q.alias("q"), (F.col("l_suppkey") % 3 + 1).alias("t"), (F.col("l_partkey") % 3 + 1).alias("u"))
    way, text = (F.col("l_orderkey") + F.col("n")) % 4, lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    n, q, t, u = (F.col(c) for c in "nqtu")
    pred = F.when(way == 0, text(q, "/", n)).when(way == 1, text("$", q, "%")).when(way == 2, text("y = ", F.format_number(q * 1000 * t, 0))).otherwise(text("(x + ", t, ")^2"))
    target = F.when(way == 0, text("\\frac{", q * t, "}{", n * u, "}")).when(way == 1, text(q * t, " / ", 100 * u)).when(way == 2, text(q * 1000 * u, " kg")).otherwise(text("x^2 + ", 2 * u, " * x + ", u * u))
    return w.select("l_orderkey", "l_linenumber", pred.alias("pred"), target.alias("target")).withColumn("same", numeric.equivalent_udf("pred", "target"))


# documents and tagged completions together, so that every way to an answer occurs
_TEXTS = f"{TAGGED}, texts as (select doc_id as k, coalesce(source, '') as g, text from documents where text is not null union all select -item_id, 'items', c from tagged)"


def texts_with_tags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("k"), F.coalesce("source", F.lit("")).alias("g"), "text")
    return docs.unionByName(tagged(spark, d).select((-F.col("item_id")).alias("k"), F.lit("items").alias("g"), F.col("c").alias("text")))


_INSIDE = "regexp_extract(text, '(?s)<answer>(.*?)</answer>', 1)"


@query("r10_last_number", rf"with {_TEXTS} select k, regexp_extract_all(case when {_INSIDE} <> '' then {_INSIDE} else text end, '[-+]?\d*\.\d+|\d+')[-1] as n from texts")
def r10_last_number(spark: SparkSession, d: str) -> DataFrame:
    return texts_with_tags(spark, d).select("k", rewards.last_number(F.col("text")).alias("n"))


@query("r13_jury", "with x as (select user_id, event_type, avg(value / 200) as s from events group by all), c as (select user_id, avg(least(1, greatest(0, s))) as mean, stddev_pop(least(1, greatest(0, s))) as std from x group by 1) select user_id, round(mean, 6) as mean, round(std, 6) as std, round(greatest(0, mean - 2 * std), 6) as reward, round(std, 6) >= 0.2 as controversial from c")
def r13_jury(spark: SparkSession, d: str) -> DataFrame:
    """Event types as judges of a user."""
    scores = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.avg(F.col("value") / 200)).alias("s"))
    j = rewards.jury(scores, "user_id", "event_type", "s")
    return r6(j.select("user_id", "mean", "std", "reward")).withColumn("controversial", F.col("std") >= 0.2)


_PARTS = f"list_filter(list_transform(string_split({strip_sql('text')}, '.'), lambda s: {strip_sql('s')}), lambda s: s <> '')"


_CONCLUDED = f"""c as (select g, k, case when regexp_matches(text, '(?s)<answer>.*?</answer>') then lower({strip_sql(_INSIDE)}) else lower(coalesce({_PARTS}[-1], {strip_sql('text')})) end as conclusion from texts), n as (select g, conclusion, count(*) as n, min(k) as first from c group by all),
r as (select g, conclusion, n, sum(n) over (partition by g) as total from n qualify row_number() over (partition by g order by n desc, first) = 1)"""


@query("r14_consensus", f'with {_TEXTS}, {_CONCLUDED} select g as "group", conclusion as winner, round(n / total, 6) as ratio, n / total >= 0.6 as agreed, n, total::bigint as total from r')
def r14_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source, and the tagged completions, as groups."""
    return r6(rewards.consensus(texts_with_tags(spark, d), "g", "k", "text"))


@query("r14_members", f'with {_TEXTS}, {_CONCLUDED} select g as "group", k from c join r using (g, conclusion)')
def r14_members(spark: SparkSession, d: str) -> DataFrame:
    return rewards.consensus_members(texts_with_tags(spark, d), "g", "k", "text")


_WS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"


@query("r15_cycle", f"with w as (select example_id, {_WS.format('prompt')} as a, {_WS.format('completion')} as b from sft_examples where prompt is not null and completion is not null) select example_id, round(case when len(a) > 0 then len(list_intersect(a, b))::double / len(a) when len(b) = 0 then 1 else 0 end, 6) as overlap from w")
def r15_cycle(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sft_examples").where("prompt is not null and completion is not null")
    return r6(rows.select("example_id", rewards.cycle_overlap(F.col("prompt"), F.col("completion")).alias("overlap")))


_FW = ", ".join(repr(x) for x in rewards.FUNCTION_WORDS)
_SENT = f"len(list_filter(string_split(completion, '.'), lambda s: {strip_sql('s')} <> ''))"


@query(
    "r16_fluency",
    rf"""with w as (select example_id, regexp_extract_all(lower(completion), '[\p{{L}}\p{{N}}_]+') as w, {_SENT} as s from sft_examples where completion is not null),
m as (select example_id, len(w) as n, len(list_filter(w, lambda x: x in ({_FW})))::double / len(w) as r, len(w)::double / greatest(1, s) as a from w),
p as (select example_id, case when n = 0 then 100 else round(9.0::double + case when r < 0.2::double then (0.2::double - r) / 0.2::double * 50 else 0 end + case when a < 4 then (4 - a) / 4 * 30 else 0 end, 2) end as ppl from m)
select example_id, round(ppl, 1) as ppl, round(least(2, 0.05::double * greatest(0, round(ppl, 1) - 14)), 6) as penalty, round(ppl, 1) > 30 as soup from p""",
)
def r16_fluency(spark: SparkSession, d: str) -> DataFrame:
    """R16 and R17."""
    rows = table(spark, d, "sft_examples").where("completion is not null").select("example_id", F.round(rewards.perplexity_estimate(F.col("completion")), 1).alias("ppl"))
    return r6(rows.select("example_id", "ppl", rewards.fluency_penalty(F.col("ppl")).alias("penalty"), rewards.is_soup(F.col("ppl")).alias("soup")))


_ADV = f"""with {A.ROLLOUTS}, m as (select *, avg(reward) over (partition by batch, grp) as gm, stddev_pop(reward) over (partition by batch, grp) as gs, avg(reward) over (partition by batch) as bm, stddev_pop(reward) over (partition by batch) as bs from rollouts)"""


@query("g1_advantages", _ADV + " select k, round(case when gs > 1e-8 then (reward - gm) / (gs + 1e-8) when bs > 1e-8 then (reward - bm) / (bs + 1e-8) else 0 end, 6) + 0.0 as advantage, case when gs > 1e-8 then 'intra_group' when bs > 1e-8 then 'batch_fallback' else 'zero_fallback' end as mode from m")
def g1_advantages(spark: SparkSession, d: str) -> DataFrame:
    """G1-G3."""
    return r6(grpo.advantages(A.rollouts(spark, d), "batch", "grp", "reward").select("k", "advantage", "mode"))


_STREAK = "b as (select (user_id % 4)::int as run, ts::date as day, hour(ts)::int as h, stddev_pop(case when event_type = 'purchase' then 1.5::double else 0 end) as std from events group by all), o as (select *, day::varchar || '-' || lpad(h::varchar, 2, '0') as slot from b), i as (select *, sum(case when std < 1e-8 then 0 else 1 end) over (partition by run order by slot) as island from o)"


@query("g4_streaks", f"with {_STREAK} select run, slot, sum(case when std < 1e-8 then 1 else 0 end) over (partition by run, island order by slot)::bigint as streak from i")
def g4_streaks(spark: SparkSession, d: str) -> DataFrame:
    """Hours of a day as batches."""
    e = table(spark, d, "events")
    at = F.concat_ws("-", F.to_date("ts").cast("string"), F.lpad(F.hour("ts").cast("string"), 2, "0"))
    b = e.groupBy((F.col("user_id") % 4).cast("int").alias("run"), at.alias("slot")).agg(F.stddev_pop(F.when(F.col("event_type") == "purchase", 1.5).otherwise(0.0)).alias("std"))
    return grpo.flat_streaks(b, "run", "slot", "std").select("run", "slot", "streak")


@query(
    "g5_anchor",
    f"""with {A.ROLLOUTS}, m as (select batch, min(grp) as g from rollouts where day(batch) % 3 = 0 group by 1), l as (select r.batch, any_value(m.g) as g, max(r.k) as last from rollouts r join m on r.batch = m.batch and r.grp = m.g group by 1),
x as (select r.batch, r.grp, r.k, l.g, case when r.grp = l.g and r.k = l.last then 'golden' else 'c' || r.reward::varchar end as completion, case when r.grp = l.g and r.k = l.last then 1.5 else r.reward end as reward from rollouts r left join l using (batch)),
w as (select batch, grp, any_value(g) as g, list(completion order by k) as whole from x group by 1, 2), s as (select w.batch, w.grp, coalesce(w.whole = a.whole, false) as anchored from w left join w a on a.batch = w.batch and a.grp = w.g),
v as (select *, stddev_pop(reward) over (partition by batch, grp) as gs, stddev_pop(reward) over (partition by batch) as bs from x)
select batch, anchored, case when gs > 1e-8 then 'intra_group' when bs > 1e-8 then 'batch_fallback' else 'zero_fallback' end as mode, count(*) as n, count_if(completion = 'golden') as golden from v join s using (batch, grp) group by 1, 2, 3""",
)
def g5_anchor(spark: SparkSession, d: str) -> DataFrame:
    """An anchor in days whose number is divisible by three."""
    rows = A.rollouts(spark, d).withColumn("completion", F.concat(F.lit("c"), F.col("reward").cast("string")))
    marks = rows.select("batch").distinct().where(F.dayofmonth("batch") % 3 == 0)
    out = grpo.with_anchor(rows, marks, "batch", "grp", "k", "completion", "reward", "golden", 1.5)
    return r6(grpo.advantages(out, "batch", "grp", "reward").groupBy("batch", "anchored", "mode").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("completion") == "golden").alias("golden")))


@query("g6_sizes", f"with {A.ROLLOUTS} select batch, grp, count(*) as n from rollouts group by all having count(*) <> 2")
def g6_sizes(spark: SparkSession, d: str) -> DataFrame:
    return grpo.wrong_sizes(A.rollouts(spark, d), "batch", "grp", 2)


@query("g7_evaluation", "with e as (select event_id as idx, event_type = 'purchase' as accurate, event_type in ('purchase', 'click') as format_valid, (value)::int as tokens, case event_type when 'purchase' then 1.5::double when 'click' then 0.5::double else 0 end as reward from events) select count(*) as n, count_if(accurate) as correct, count_if(format_valid) as formatted, count_if(tokens >= 100) as at_limit, round(count_if(accurate) / count(*), 6) as accuracy, round(count_if(format_valid) / count(*), 6) as format_rate, round(avg(reward), 6) as reward from e")
def g7_evaluation(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, d, "events").select((kind == "purchase").alias("accurate"), kind.isin("purchase", "click").alias("format_valid"), F.round("value").cast("int").alias("tokens"), F.when(kind == "purchase", 1.5).when(kind == "click", 0.5).otherwise(0.0).alias("reward"))
    return r6(grpo.evaluation(rows, 100))


@query("g8_before_after", "select event_type = 'purchase' as a_won, value > 50 as b_won, count(*) as n from events group by all")
def g8_before_after(spark: SparkSession, d: str) -> DataFrame:
    """G8, J1 and J2."""
    e = table(spark, d, "events")
    return grpo.before_after(e.select("event_id", (F.col("event_type") == "purchase").alias("ok")), e.select("event_id", (F.col("value") > 50).alias("ok")), "event_id", "ok")


@query("g9_weight_delta", "select round(sum(value), 4) as total, round(max(value), 6) as largest, count_if(value > 0) as changed from events")
def g9_weight_delta(spark: SparkSession, d: str) -> DataFrame:
    out = grpo.weight_delta(table(spark, d, "events"), "value")
    return out.select(F.round("total", 4).alias("total"), F.round("largest", 6).alias("largest"), "changed")


@query("g10_flags", f"with {A.STEPS} select run, bool_or(format_reward > 0.5) as varied, bool_or(accuracy_reward > 0) as learned from steps group by run")
def g10_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = A.steps(spark, d).select("run", (F.col("format_reward") - 0.5).alias("reward_std"), F.col("accuracy_reward").alias("grad_norm"))
    return grpo.step_flags(rows, ["run"])


@query("r11_code", "select event_id, case when event_type = 'purchase' then 1.0::double else 0.0::double end as reward from events")
def r11_code(spark: SparkSession, d: str) -> DataFrame:
    """Event types as results of tests."""
    return table(spark, d, "events").select("event_id", rewards.code_reward(F.col("event_type") == "purchase").alias("reward"))


@query("r12_content", "select row_id, chosen[1].content as text from clipped_completions")
def r12_content(spark: SparkSession, d: str) -> DataFrame:
    """R12 and J3."""
    return table(spark, d, "clipped_completions").select("row_id", rewards.message_text(F.col("chosen")).alias("text"))
