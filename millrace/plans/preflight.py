"""Queries P1-P20 and D1-D23 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.stats import distribution, histogram, ks_statistic
from millrace.functions.text import jaccard, tokens_quarter
from millrace.operators import dpo, sft
from millrace.plans import adapters as A
from millrace.plans.adapters import char4_sql, strip_sql
from millrace.plans.registry import query
from millrace.session import table


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Round doubles for comparison: all of them, or those named."""
    return df.withColumns({c: F.round(c, 6) + 0.0 for c, t in df.dtypes if t == "double" and (not names or c in names)})


def sft_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sft_examples").select(F.col("example_id").alias("ordinal"), "prompt", "completion")


_P = strip_sql("coalesce(prompt, '')")
_C = strip_sql("coalesce(completion, '')")
FEATURES = f"""extracted as (
  select example_id as ordinal, {_P} as p, {_C} as c from sft_examples
), lens as (
  select *, ({char4_sql('p')})::int as prompt_len, (case when c = '' then 0 else {char4_sql('c')} end)::int as answer_len from extracted
), feats as (
  select *, prompt_len + answer_len as raw_len, least(prompt_len + answer_len, 256) as total_len, greatest(least(prompt_len + answer_len, 256) - prompt_len, 0) as target_len, c = '' as empty, p <> '' as valid,
    prompt_len + answer_len > 256 and greatest(least(prompt_len + answer_len, 256) - prompt_len, 0) < answer_len as truncated from lens
)"""


@query("p_extract", f"select example_id as ordinal, {_P} as p, {_C} as c, {_P} <> '' as valid, case when {_P} = '' then 'Empty or missing prompt' end as error from sft_examples")
def p_extract(spark: SparkSession, d: str) -> DataFrame:
    """P1 on keyed rows."""
    return sft.extracted(sft_rows(spark, d)).select("ordinal", "p", "c", "valid", "error")


_ROLE = "array_to_string(list_transform(list_filter(chosen, lambda m: m.role = '{0}'), lambda m: coalesce(m.content, '')), chr(10))"


@query("p_extract_messages", f"select row_id, {strip_sql(_ROLE.format('user'))} as p, {strip_sql(_ROLE.format('assistant'))} as c, {strip_sql(_ROLE.format('user'))} <> '' as valid from clipped_completions")
def p_extract_messages(spark: SparkSession, d: str) -> DataFrame:
    """P1 on message lists."""
    rows = table(spark, d, "clipped_completions").select("row_id", F.col("chosen").alias("messages"))
    return sft.extracted(rows).select("row_id", "p", "c", "valid")


@query("p_lengths", f"with {FEATURES} select ordinal, prompt_len, answer_len, raw_len, total_len, target_len, empty, truncated from feats where valid")
def p_lengths(spark: SparkSession, d: str) -> DataFrame:
    """P2-P4 and P7."""
    return sft.featurised(sft.extracted(sft_rows(spark, d)), 256).where("valid").select("ordinal", "prompt_len", "answer_len", "raw_len", "total_len", "target_len", "empty", "truncated")


@query(
    "p_anomalies",
    f"""with {FEATURES} select count(*) as total, count_if(not valid) as invalid, count_if(valid and empty) as empty, count_if(valid and not empty and truncated) as truncated, count_if(valid and raw_len > 256) as over_length,
  count_if(valid and (ordinal % 7 = 3 or ordinal % 7 = 5 and not empty and target_len > 0)) as misaligned, count_if(valid and not empty) as valid, count_if(valid) - count(distinct case when valid then lower(p) end) as duplicates from feats""",
)
def p_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Labels of lengths' places, of which every seventh row teaches its prompt and another masks its answer."""
    rows = sft.featurised(sft.extracted(sft_rows(spark, d)), 256)
    k, hidden = F.col("ordinal") % 7, F.array_repeat(F.lit(sft.IGNORED), F.col("prompt_len"))
    answer = F.array_repeat(F.when(k == 5, sft.IGNORED).otherwise(1), F.col("target_len"))
    labels = F.transform(F.concat(hidden, answer), lambda x, i: F.when((k == 3) & (i == 0), 5).otherwise(x))
    return sft.anomaly_counts(rows.withColumn("misaligned", sft.misaligned(labels, F.col("prompt_len"), F.col("empty"))), 256)


@query(
    "p_length_stats",
    f"""with {FEATURES} select count(*) as n, round(avg(total_len), 6) as mean, round(stddev_pop(total_len), 6) as std, round(stddev_pop(total_len) / avg(total_len), 6) as cv, min(total_len) as shortest, max(total_len) as longest,
  round(quantile_cont(total_len, 0.95), 6) as p95, round(quantile_cont(total_len, 0.99), 6) as p99, round(avg(prompt_len), 6) as avg_prompt, round(avg(target_len), 6) as avg_target from feats where valid""",
)
def p_length_stats(spark: SparkSession, d: str) -> DataFrame:
    """P10."""
    return r6(sft.length_stats(sft.featurised(sft.extracted(sft_rows(spark, d)), 256).where("valid")))


@query(
    "p_padding_waste",
    f"""with {FEATURES}, o as (select total_len, row_number() over (order by ordinal) - 1 as k from feats where valid), b as (select max(total_len) * count(*) as padded, sum(total_len) as useful from o group by k // 4)
select sum(useful)::bigint as useful, sum(padded)::bigint as padded, round((sum(padded) - sum(useful)) / sum(padded) * 100, 6) as waste_pct from b""",
)
def p_padding_waste(spark: SparkSession, d: str) -> DataFrame:
    """P11."""
    rows = sft.featurised(sft.extracted(sft_rows(spark, d)), 256).where("valid").select(F.col("ordinal").alias("o"), "total_len")
    return r6(sft.padding_waste(sft.dense_ordinal(rows, "o"), "total_len", "ordinal", 4))


@query(
    "p_drift",
    f"""with {FEATURES}, a as (select total_len as v from feats where valid and ordinal % 2 = 0), b as (select total_len as v from feats where valid and ordinal % 2 = 1),
g as (select v, sum(x) as x, sum(y) as y from (select v, 1 as x, 0 as y from a union all select v, 0, 1 from b) group by v),
c as (select sum(x) over (order by v) / sum(x) over () as cx, sum(y) over (order by v) / sum(y) over () as cy, sum(x) over () as n, sum(y) over () as m from g)
select round(max(abs(cx - cy)), 6) as d, max(n)::bigint as n, max(m)::bigint as m from c""",
)
def p_drift(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of rows with even ids against those with odd ones."""
    rows = sft.featurised(sft.extracted(sft_rows(spark, d)), 256).where("valid").select("ordinal", F.col("total_len").alias("v"))
    return r6(ks_statistic(rows.where("ordinal % 2 = 0").select("v"), rows.where("ordinal % 2 = 1").select("v")))


_WARNED = ", ".join(f"case when {c} > 0 then '{c}' end" for c in ("invalid", "empty", "truncated", "duplicates", "over_length"))


@query(
    "p_report",
    f"""with {FEATURES}, o as (select total_len, row_number() over (order by ordinal) - 1 as k from feats where valid), b as (select max(total_len) * count(*) as padded, sum(total_len) as useful from o group by k // 4),
w as (select sum(useful)::bigint as useful, sum(padded)::bigint as padded, round((sum(padded) - sum(useful)) / sum(padded) * 100, 6) as waste_pct from b),
c as (select count(*) as total, count_if(not valid) as invalid, count_if(valid and empty) as empty, count_if(valid and not empty and truncated) as truncated, count_if(valid and raw_len > 256) as over_length, 0 as misaligned, count_if(valid and not empty) as valid, count_if(valid) - count(distinct case when valid then lower(p) end) as duplicates from feats),
s as (select count(*) as n, round(avg(total_len), 6) as mean, round(stddev_pop(total_len), 6) as std, round(stddev_pop(total_len) / avg(total_len), 6) as cv, min(total_len) as shortest, max(total_len) as longest, round(quantile_cont(total_len, 0.95), 6) as p95, round(quantile_cont(total_len, 0.99), 6) as p99, round(avg(prompt_len), 6) as avg_prompt, round(avg(target_len), 6) as avg_target from feats where valid)
select *, array_to_string(list_filter([{_WARNED}], lambda x: x is not null), ',') as warnings, case when invalid + empty + truncated > 0 then 'Validation Alerts Detected' when duplicates + over_length > 0 then 'Optimization Advisories' else 'Clean Execution' end as gate from c, s, w""",
)
def p_report(spark: SparkSession, d: str) -> DataFrame:
    """P7-P14 as one row."""
    return r6(sft.report(sft_rows(spark, d), 256).withColumn("warnings", F.array_join("warnings", ",")))


_ADVISED = " union all ".join(f"select '{k}' as kind, '{v}' as severity, {k}::bigint as n, round({k} * 100.0::double / total, 6) as share_pct, '{t.replace(chr(39), chr(39) * 2)}' as text from r where {k} > 0" for k, v, t in sft.ADVICE)


@query("p_advice", f"with {FEATURES}, o as (select total_len, row_number() over (order by ordinal) - 1 as k from feats where valid), b as (select max(total_len) * count(*) as padded, sum(total_len) as useful from o group by k // 4), w as (select sum(useful)::bigint as useful, sum(padded)::bigint as padded from b), r as (select count(*) as total, count_if(not valid) as invalid, count_if(valid and empty) as empty, count_if(valid and not empty and truncated) as truncated, 0 as misaligned, count_if(valid) - count(distinct case when valid then lower(p) end) as duplicates, count_if(valid and raw_len > 256) as over_length from feats) {_ADVISED} union all select 'padding', 'advice', padded - useful, round((padded - useful) * 100.0::double / padded, 6), 'of all places are padding: batch rows of like length, or pack them' from w where (padded - useful) * 100.0::double / padded > 20")
def p_advice(spark: SparkSession, d: str) -> DataFrame:
    """P14."""
    return r6(sft.advice(sft.report(sft_rows(spark, d), 256)))


@query("p_drift_alert")
def p_drift_alert(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of answered rows against those of rows with long prompts, with the p-value's alert. The p-value counts lattice paths, which SQL can't say."""
    rows = sft.featurised(sft.extracted(sft_rows(spark, d)), 256).where("valid").select("prompt_len", F.col("total_len").alias("v"))
    distance, p = sft.drift(rows.select("v"), rows.where("prompt_len > 20").select("v"))
    return sft.advice(sft.report(sft_rows(spark, d), 256), p).where("kind = 'drift'").withColumn("distance", F.lit(distance))


@query("p_token_lengths")
def p_token_lengths(spark: SparkSession, d: str) -> DataFrame:
    """P2 by a public tokenizer's file; its tests count by the tokenizer itself."""
    return sft.featurised(sft.extracted(sft_rows(spark, d)), 256, "byte_bpe_50k.tiktoken").select("ordinal", "prompt_len", "answer_len", "raw_len", "total_len", "target_len", "boundary_ok", "truncated")


@query(
    "p_labels",
    f"""with x as (select example_id as ordinal, {_P} as p, {_C} as c from sft_examples), t as (select ordinal, length(p)::int as prompt_len, substr(p || c, 1, 512) as s from x where p <> '' and c <> ''),
n as (select *, length(s) as n, max(length(s)) over (partition by ordinal // 8) as width, sum(length(s)) over (partition by ordinal // 8) as useful, count(*) over (partition by ordinal // 8) as b from t)
select ordinal, prompt_len, false as wrong, width::int as width, useful::bigint as useful, (width * b)::bigint as padded,
  md5(array_to_string(list_transform(range(1, width + 1), lambda i: case when i <= prompt_len or i > n then -100 else unicode(substr(s, i, 1)) end), ' ')) as labels, md5(repeat('1', n) || repeat('0', (width - n)::int)) as mask from n""",
)
def p_labels(spark: SparkSession, d: str) -> DataFrame:
    """P3-P6 on arrays: code points as token ids."""
    rows = sft.extracted(sft_rows(spark, d)).where("valid and c <> ''")
    ids = lambda c: F.transform(F.split(c, ""), F.ascii)
    rows = rows.select("ordinal", ids(F.col("p")).alias("a"), ids(F.col("c")).alias("b")).select("ordinal", F.size("a").alias("prompt_len"), sft.right_truncated(F.concat("a", "b"), 512).alias("ids"))
    rows = rows.withColumn("labels", sft.answer_labels(F.col("ids"), F.col("prompt_len"))).withColumn("wrong", sft.misaligned(F.col("labels"), F.col("prompt_len"), F.lit(False)))
    done = sft.collated(rows.withColumn("batch", F.floor(F.col("ordinal") / 8)), "batch", "ids", "labels")
    return done.select("ordinal", "prompt_len", "wrong", F.size("padded_ids").alias("width"), "useful", "padded", F.md5(F.array_join("padded_labels", " ")).alias("labels"), F.md5(F.array_join("mask", "")).alias("mask"))


@query("p_batch_faults", "select ['clean', 'nothing supervised', 'prompt supervised', 'padding supervised'][example_id % 4 + 1] as detector, count(*) as right, count(*) as cases from sft_examples where prompt is not null group by 1")
def p_batch_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth row is given a fault that the checks must find."""
    rows = sft_rows(spark, d).where("prompt is not null").select("ordinal", F.lit([1, 5, 6, 7, 2, 0, 0]).alias("ids"), F.lit(3).alias("prompt_len"), F.lit(5).alias("used"))
    k = F.col("ordinal") % 4
    labels = F.when(k == 1, F.lit([-100] * 7)).when(k == 2, F.lit([-100, 5, 6, 7, 2, -100, -100])).when(k == 3, F.lit([-100, -100, -100, 7, 2, 0, -100])).otherwise(F.lit([-100, -100, -100, 7, 2, -100, -100]))
    found = sft.batch_faults(rows.withColumn("labels", labels))
    cases = found.select(F.coalesce("fault", F.lit("clean")).alias("detector"), (k != 0).alias("faulty"), F.col("fault").isNotNull().alias("blocked"))
    return sft.scoreboard(cases)


@query("p_reconciled", "select case when example_id % 3 = 0 then 'without last' when example_id % 5 = 0 then 'missing' else 'same' end as verdict, count(*) as n from sft_examples where length(completion) > 0 group by 1")
def p_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Every third row lost its last id on the way, some others never came."""
    k = F.col("ordinal") % 3 == 0
    rows = sft_rows(spark, d).where(F.length("completion") > 0).select("ordinal", F.transform(F.split("completion", ""), F.ascii).alias("ids"))
    less = rows.where(k | (F.col("ordinal") % 5 != 0)).select("ordinal", F.when(k, F.slice("ids", 1, F.greatest(F.size("ids") - 1, F.lit(0)))).otherwise(F.col("ids")).alias("ids"))
    return sft.reconciled(less, rows, "ordinal").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def dpo_rows(spark: SparkSession, d: str) -> DataFrame:
    return A.preference_pairs(spark, d)


def _side(s: str) -> str:
    return strip_sql(f"coalesce(list_filter({s}, lambda m: m.role = 'assistant' and m.content <> '')[1].content, {s}[2].content, '')")


def _user(s: str) -> str:
    return f"coalesce(list_filter({s}, lambda m: m.role = 'user' and m.content <> '')[1].content, {s}[1].content, '')"


def _mismatch(s: str) -> str:
    return f"coalesce(len({s}) > 0 and {_user(s)} <> '' and coalesce(prompt, '') <> '' and {strip_sql(_user(s))} <> {strip_sql('prompt')}, false)"


_JAC = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+'), lambda w: w <> ''))"


def jaccard_sql(a: str, b: str) -> str:
    x, y = _JAC.format(a), _JAC.format(b)
    return f"case when len({x}) > 0 and len({y}) > 0 then len(list_intersect({x}, {y}))::double / len(list_distinct(list_concat({x}, {y}))) else 0.0 end"


PAIRS = f"""sided as (
  select row_id, prompt, score_chosen, score_rejected, {_side('chosen')} as chosen_text, {_side('rejected')} as rejected_text, {_mismatch('chosen')} or {_mismatch('rejected')} as mismatch from clipped_completions
), marked as (
  select *, {strip_sql("coalesce(prompt, '')")} = '' or chosen_text = '' or rejected_text = '' as missing from sided
), judged as (
  select *, not missing and coalesce(score_chosen < score_rejected, false) and not isnan(coalesce(score_chosen, 0)) and not isnan(coalesce(score_rejected, 0)) as reversed,
    not missing and coalesce(score_chosen = score_rejected, false) and not isnan(coalesce(score_chosen, 0)) as tied, not missing and lower(chosen_text) = lower(rejected_text) as identical,
    case when not missing then {jaccard_sql('chosen_text', 'rejected_text')} end as similarity,
    ({char4_sql('prompt')})::int as prompt_len, ({char4_sql('chosen_text')})::int as chosen_len, ({char4_sql('rejected_text')})::int as rejected_len from marked
)"""


@query("d_sides", f"with {PAIRS} select row_id, chosen_text, rejected_text, missing, mismatch from judged")
def d_sides(spark: SparkSession, d: str) -> DataFrame:
    """D1-D3."""
    return dpo.sides(dpo_rows(spark, d)).select("row_id", "chosen_text", "rejected_text", "missing", "mismatch")


@query("d_judged", f"with {PAIRS} select row_id, reversed, tied, identical, round(similarity, 6) as similarity, not missing and not identical and similarity >= 0.9 as near_identical from judged")
def d_judged(spark: SparkSession, d: str) -> DataFrame:
    """D4-D6."""
    return r6(dpo.judged(dpo.sides(dpo_rows(spark, d))).select("row_id", "reversed", "tied", "identical", "similarity", "near_identical"))


@query(
    "d_report",
    f"""with {PAIRS}, one as (select count(*) as total, count_if(not missing) as valid, count_if(missing) as empty_pairs, count_if(not missing and mismatch) as mismatched, count_if(identical) as identical,
  count_if(not missing and not identical and similarity >= 0.9) as near_identical, count_if(reversed) as reversed, count_if(tied) as tied, count_if(not missing) - count(distinct case when not missing then lower({strip_sql('prompt')}) end) as duplicates,
  count_if(not missing and prompt_len > 1024) as long_prompts, count_if(not missing and (chosen_len > 1024 or rejected_len > 1024)) as long_completions, count_if(not missing and (prompt_len + chosen_len > 2048 or prompt_len + rejected_len > 2048)) as over_total,
  avg(case when not missing then prompt_len end) as avg_prompt, avg(case when not missing then chosen_len end) as avg_chosen, avg(case when not missing then rejected_len end) as avg_rejected from judged)
select total, valid, empty_pairs, mismatched, identical, near_identical, reversed, tied, duplicates, long_prompts, long_completions, over_total, round(avg_prompt, 6) as avg_prompt, round(avg_chosen, 6) as avg_chosen, round(avg_rejected, 6) as avg_rejected,
  round(avg_chosen / avg_rejected, 6) as length_ratio, 0 as invalid_json, case when identical + reversed + empty_pairs + mismatched > 0 then 'Defects Detected' when avg_chosen / avg_rejected > 1.8 or avg_chosen / avg_rejected < 0.55 then 'Quality Warnings' else 'Clean Execution' end as gate from one""",
)
def d_report(spark: SparkSession, d: str) -> DataFrame:
    """D2-D11."""
    return r6(dpo.report(dpo_rows(spark, d)))


def _dist_sql(name: str, x: str) -> str:
    out = [f"round(avg({x}), 6) as {name}_mean", f"round(stddev_pop({x}), 6) as {name}_std", f"round(min({x})::double, 6) as {name}_min"]
    out += [f"round(quantile_cont({x}, {q / 100}), 6) as {name}_p{q}" for q in (10, 25, 50, 75, 90, 95, 99)]
    return ", ".join([*out, f"round(max({x})::double, 6) as {name}_max"])


_MARGIN = "case when not isnan(coalesce(score_chosen, 0)) and not isnan(coalesce(score_rejected, 0)) then score_chosen - score_rejected end"


@query(
    "d_profile",
    f"""with {PAIRS}, m as (select *, {_MARGIN} as margin from judged) select count(*) as total, count_if({strip_sql("coalesce(prompt, '')")} = '') as blank_prompts, count_if(chosen_text = '') as no_chosen, count_if(rejected_text = '') as no_rejected, count_if(mismatch) as mismatched,
  count_if(margin is null) as no_scores, count_if(identical) as identical, count_if(similarity >= 0.9) as similar_90, count_if(similarity >= 0.8) as similar_80, count_if(chosen_len > 2 * rejected_len or rejected_len > 2 * chosen_len) as twice_as_long,
  {_dist_sql('margin', 'margin')}, {_dist_sql('prompt_len', 'prompt_len')}, {_dist_sql('chosen_len', 'chosen_len')}, {_dist_sql('rejected_len', 'rejected_len')} from m""",
)
def d_profile(spark: SparkSession, d: str) -> DataFrame:
    """D15 and D16."""
    return r6(dpo.profile(dpo_rows(spark, d)))


def _there(s: str) -> str:
    return f"coalesce(len({s}) >= 2, false)"


def _roles(s: str) -> str:
    return f"({s}[1].role is distinct from 'user' or {s}[2].role is distinct from 'assistant') as {s}_role, {strip_sql(f"coalesce({s}[1].content, '')")} <> {strip_sql('prompt')} as {s}_user"


_CUT = {"prompt_len": 1024, "chosen_len": 1024, "rejected_len": 1024}
_FAILURES = {f"missing_{s}": f"gone = '{s}'" for s in ("prompt", "chosen", "rejected")} | {"missing_scores": "gone is null and margin is null"} | {f"{s}_{n}_mismatch": f"gone is null and {s}_{c}" for n, c in (("role", "role"), ("prompt", "user")) for s in ("chosen", "rejected")}
_OVER = {"prompt_over": "prompt_len > 1024", "chosen_over": "chosen_len > 1024", "rejected_over": "rejected_len > 1024", "chosen_total_over": "prompt_len + chosen_len > 2048", "rejected_total_over": "prompt_len + rejected_len > 2048"}
_FLAGS = _FAILURES | {"reversed": "margin < 0", "tied": "margin = 0", "positive": "margin > 0"} | _OVER | {"any_over": " or ".join(_OVER.values())}
_FLAGS |= {"identical": "same", "near_identical_90": "not same and similarity >= 0.9", "elevated_80": "not same and similarity >= 0.8 and similarity < 0.9", "chosen_twice": "chosen_len > 2 * rejected_len", "rejected_twice": "rejected_len > 2 * chosen_len"}
_NUMBERS = ["score_chosen", "score_rejected", "margin", "similarity", *_CUT, "delta_len", *[f"{n}_cut" for n in _CUT], "delta_len_cut"]


@query(
    "d_profile_whole",
    f"""with g as (
  select *, case when coalesce(prompt, '') = '' then 'prompt' when not {_there('chosen')} then 'chosen' when not {_there('rejected')} then 'rejected' end as gone, coalesce(chosen[2].content, '') as a, coalesce(rejected[2].content, '') as b, {_roles('chosen')}, {_roles('rejected')},
    score_chosen is not null and score_rejected is not null and not isnan(coalesce(score_chosen, 0)) and not isnan(coalesce(score_rejected, 0)) as scored from clipped_completions
), t as (
  select gone, chosen_role, chosen_user, rejected_role, rejected_user, case when gone is null and scored then score_chosen end as score_chosen, case when gone is null and scored then score_rejected end as score_rejected, gone is null and lower({strip_sql('a')}) = lower({strip_sql('b')}) as same,
    case when gone is null then {jaccard_sql('a', 'b')} end as similarity, case when gone is null then ({char4_sql('prompt')})::int end as prompt_len, case when gone is null then ({char4_sql('a')})::int end as chosen_len, case when gone is null then ({char4_sql('b')})::int end as rejected_len from g
), u as (
  select *, score_chosen - score_rejected as margin, chosen_len - rejected_len as delta_len, {', '.join(f'case when {n} > {k} then {k} else {n} end as {n}_cut' for n, k in _CUT.items())} from t
), m as (select *, chosen_len_cut - rejected_len_cut as delta_len_cut from u)
select count(*) as total, count_if(gone is null) as complete, {', '.join(f'count(*) filter (where {f}) as {k}' for k, f in _FLAGS.items())}, round(avg(chosen_len) / avg(rejected_len), 6) as length_ratio, round(avg(chosen_len_cut) / avg(rejected_len_cut), 6) as length_ratio_cut,
  {', '.join(_dist_sql(n, n) for n in _NUMBERS)}, round(100 * (count(*) - {' - '.join(f'count(*) filter (where {f})' for f in _FAILURES.values())})::double / count(*), 6) as clean_pct from m""",
)
def d_profile_whole(spark: SparkSession, d: str) -> DataFrame:
    """D15 and D16, with all parts."""
    return r6(dpo.whole_profile(dpo_rows(spark, d)))


def logps(spark: SparkSession, d: str) -> DataFrame:
    """idx, pi_*, ref_*: made from the scores, whose place a policy's log-probabilities take here."""
    rows = table(spark, d, "clipped_completions").where("score_chosen is not null and score_rejected is not null and not isnan(score_chosen) and not isnan(score_rejected)")
    return rows.select(F.col("row_id").alias("idx"), (F.col("score_chosen") * -3).alias("pi_chosen"), (F.col("score_rejected") * -3.5).alias("pi_rejected"), (F.col("score_chosen") * -2).alias("ref_chosen"), (F.col("score_rejected") * -2.25).alias("ref_rejected"))


LOGPS = """logps as (select row_id as idx, score_chosen * -3 as pi_chosen, score_rejected * -3.5::double as pi_rejected, score_chosen * -2 as ref_chosen, score_rejected * -2.25::double as ref_rejected from clipped_completions
  where score_chosen is not null and score_rejected is not null and not isnan(score_chosen) and not isnan(score_rejected)
), margins as (select *, 0.1::double * (pi_chosen - ref_chosen) as reward_chosen, 0.1::double * (pi_rejected - ref_rejected) as reward_rejected from logps), losses as (select *, reward_chosen - reward_rejected as margin, greatest(-(reward_chosen - reward_rejected), 0) + ln(1 + exp(-abs(reward_chosen - reward_rejected))) as loss from margins)"""


@query("d_implicit_rewards", f"with {LOGPS} select idx, round(reward_chosen, 6) + 0.0 as reward_chosen, round(reward_rejected, 6) + 0.0 as reward_rejected, round(margin, 6) + 0.0 as margin, round(loss, 6) + 0.0 as loss from losses")
def d_implicit_rewards(spark: SparkSession, d: str) -> DataFrame:
    """D17."""
    return r6(dpo.implicit_rewards(logps(spark, d)).select("idx", "reward_chosen", "reward_rejected", "margin", "loss"))


@query(
    "d_population",
    f"""with {LOGPS}, r as (select *, round(margin, 9) as m from losses) select count_if(m > 0) as positive, count_if(m = 0) as zero, count_if(m < 0) as negative, round(count_if(m > 0) / count(*), 6) as accuracy, round(avg(m), 6) as mean,
  round(quantile_disc(m, 0.5), 6) as lower_median, round(stddev_samp(m), 6) as std, round(avg(loss), 6) as loss, count_if(ref_chosen > ref_rejected) as likelihood_wins from r""",
)
def d_population(spark: SparkSession, d: str) -> DataFrame:
    """D18 and D20."""
    return r6(dpo.population(dpo.implicit_rewards(logps(spark, d)).withColumn("margin", F.round("margin", 9))))


@query("d_batch_accuracy", f"with {LOGPS}, o as (select round(margin, 9) as m, row_number() over (order by idx) - 1 as k from losses), b as (select avg(case when m > 0 then 1.0 else 0.0 end) as a from o group by k // 2) select count(*) as batches, round(avg(a), 6) as batch_accuracy from b")
def d_batch_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """D19."""
    rows = dpo.implicit_rewards(logps(spark, d)).withColumn("margin", F.round("margin", 9)).select(F.col("idx").alias("o"), "margin")
    return r6(dpo.batch_mean_accuracy(sft.dense_ordinal(rows, "o"), "ordinal"))


_MEASURES = ("pi_chosen", "pi_rejected", "reward_chosen", "reward_rejected", "margin", "loss")


@query(
    "d_evaluator_differences",
    f"""with {LOGPS}, b as (select idx, {', '.join(f"{m} + (case when idx % {k + 5} = 0 then -0.001 else 0.0001 end)::double as {m}" for k, m in enumerate(_MEASURES))} from losses)
select count(*) as pairs, {', '.join(f'round(avg(abs(a.{m} - b.{m})), 6) as {m}_mean, round(max(abs(a.{m} - b.{m})), 6) as {m}_max' for m in _MEASURES)}, count_if(sign(round(a.margin, 9)) <> sign(round(b.margin, 9))) as sign_flips from losses a join b using (idx)""",
)
def d_evaluator_differences(spark: SparkSession, d: str) -> DataFrame:
    """All six measures, the second evaluator's moved a little."""
    a = dpo.implicit_rewards(logps(spark, d)).select("idx", *_MEASURES)
    b = a.select("idx", *[(F.col(m) + F.when(F.col("idx") % (k + 5) == 0, -0.001).otherwise(0.0001)).alias(m) for k, m in enumerate(_MEASURES)])
    near = lambda x: x.withColumn("margin", F.round("margin", 9))
    return r6(dpo.evaluator_differences(near(a), near(b), "idx", list(_MEASURES)))


@query("d_transitions", f"with {LOGPS}, t as (select round(margin, 9) > 0 as a_won, ref_chosen > ref_rejected as b_won from losses) select a_won, b_won, count(*) as n from t group by all")
def d_transitions(spark: SparkSession, d: str) -> DataFrame:
    """D23."""
    rows = dpo.implicit_rewards(logps(spark, d))
    return dpo.transitions(rows.select("idx", (F.round("margin", 9) > 0).alias("won")), rows.select("idx", (F.col("ref_chosen") > F.col("ref_rejected")).alias("won")), "idx")


def _codes(x: str) -> str:
    return f"list_transform(range(1, length({x}) + 1), lambda i: unicode(substr({x}, i, 1)))"


_ZEROS = "list_transform(range(0, {0}), lambda i: 0)"


@query(
    "d_trainer_rows",
    f"""with {PAIRS}, x as (select row_id, right(prompt, 256) as prompt, chosen_text, rejected_text from judged where not missing), t as (select row_id, {_codes('prompt')} as p, list_slice({_codes('chosen_text')} || [2], 1, 512) as chosen, list_slice({_codes('rejected_text')} || [2], 1, 512) as rejected from x),
w as (select *, max(len(p)) over (partition by row_id // 4) as wp, max(greatest(len(chosen), len(rejected))) over (partition by row_id // 4) as wc from t), s as (select row_id, wp, wc, p, 'chosen' as side, chosen as c from w union all select row_id, wp, wc, p, 'rejected', rejected from w)
select row_id, side, (wp + wc)::int as width, md5(array_to_string({_ZEROS.format('wp - len(p)')} || p || c || {_ZEROS.format('wc - len(c)')}, ' ')) as ids, md5(repeat('0', wp::int) || repeat('1', wc::int)) as loss_mask from s""",
)
def d_trainer_rows(spark: SparkSession, d: str) -> DataFrame:
    """Code points as token ids."""
    rows = dpo.sides(dpo_rows(spark, d)).where("not missing")
    ids = lambda c: F.transform(F.split(c, ""), F.ascii)
    own = rows.select("row_id", ids(F.col("prompt")).alias("prompt_ids"), ids(F.col("chosen_text")).alias("chosen_ids"), ids(F.col("rejected_text")).alias("rejected_ids"))
    cut = dpo.trainer_rows(own, 2, 256, 512)
    stacked = dpo.stacked(dpo.collated(cut.withColumn("batch", F.floor(F.col("row_id") / 4)), "batch"), "row_id")
    return stacked.select("row_id", "side", F.size("ids").alias("width"), F.md5(F.array_join("ids", " ")).alias("ids"), F.md5(F.array_join("loss_mask", "")).alias("loss_mask"))


@query("d_loader_audit", "select count_if(row_id % 5 = 0 or row_id % 4 = 0 and length(prompt) > 255) as token_mismatch, count_if(length(prompt) > 255 and row_id % 4 <> 0) as no_end, count_if(length(prompt) > 255 and row_id % 4 = 0) as over_budget, count(*) as rows from clipped_completions where prompt is not null")
def d_loader_audit(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with an end token, cut to a budget of 256 places; every fifth row comes with another first token, every fourth uncut."""
    whole = F.concat(F.transform(F.split("prompt", ""), F.ascii), F.array(F.lit(0)))
    approved = sft.right_truncated(whole, 256)
    came = F.when(F.col("row_id") % 4 == 0, whole).otherwise(approved)
    changed = F.transform(came, lambda x, i: F.when((F.col("row_id") % 5 == 0) & (i == 0), -1).otherwise(x))
    rows = table(spark, d, "clipped_completions").where("prompt is not null").select(changed.alias("ids"), approved.alias("approved_ids"))
    return dpo.loader_audit(rows, 0, 256)


@query("text_estimators", f"select doc_id, ({char4_sql('text')})::int as char4, greatest(1, floor(length(text) / 3.8::double))::int as ratio from documents where text is not null")
def text_estimators(spark: SparkSession, d: str) -> DataFrame:
    """R18."""
    from millrace.functions.text import tokens_ratio

    return table(spark, d, "documents").where("text is not null").select("doc_id", tokens_quarter(F.col("text")).alias("char4"), tokens_ratio(F.col("text")).alias("ratio"))


@query("d_jaccard", f"select row_id, round({jaccard_sql('prompt', 'chosen[1].content')}, 6) as j from clipped_completions where prompt is not null and chosen[1].content is not null")
def d_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """D6."""
    rows = table(spark, d, "clipped_completions").select("row_id", "prompt", F.get("chosen", F.lit(0))["content"].alias("other")).where("prompt is not null and other is not null")
    return r6(rows.select("row_id", jaccard(F.col("prompt"), F.col("other")).alias("j")))


@query("b_length_histogram", f"with {A.LENGTHS}, e as (select min(len)::double as lo, max(len)::double as hi from lengths) select least(floor((len - lo) / (hi - lo) * 50), 49)::int as bin, count(*) as n from lengths, e group by 1")
def b_length_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The histogram."""
    return histogram(A.lengths(spark, d), "len")


@query("d_distribution", f"with {A.LENGTHS} select {_dist_sql('len', 'len')} from lengths")
def d_distribution(spark: SparkSession, d: str) -> DataFrame:
    """D16."""
    return r6(A.lengths(spark, d).agg(*[x.alias(f"len_{k}") for k, x in distribution(F.col("len")).items()]))
