"""The pN_ queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import copies, digests, leaks, packing, pairs, records, spans, truncation
from millrace.session import stored, table

METRICS = ["ttft_ms", "e2e_latency_ms", "queue_wait_ms"]


def preference_records(spark: SparkSession, d: str) -> DataFrame:
    return records.all_pairs(table(spark, d, "clipped_completions"), table(spark, d, "clipped_raw"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """record_id, field_name, source, text: the answers of both pair tables and of sft_examples."""
    own = preference_records(spark, d).select("row_id", "source", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in ("chosen", "rejected")])).alias("a"))
    single = table(spark, d, "sft_examples").select(F.col("example_id").alias("record_id"), F.lit("completion").alias("field_name"), "source", F.col("completion").alias("text"))
    return own.select(F.col("row_id").alias("record_id"), "a.field_name", "source", "a.text").unionByName(single)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_members(copies.keyed(preference_records(spark, d), "row_id", ["prompt", "chosen", "rejected"]))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    groups = copies.copy_groups(copies.keyed(preference_records(spark, d), "row_id", ["prompt", "chosen", "rejected"]))
    return groups.select("record_id", "copies", "collided")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(answers(spark, d)).select("record_id", "field_name")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_shares(answers(spark, d))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Each request once: a second delivery differs in recorded_at only."""
    rows = table(spark, d, "gateway_requests").select("request_id", "run_id", F.to_date(F.timestamp_seconds("arrival_time")).alias("day"), *METRICS)
    return rows.distinct()


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """By run and day, and by run over all its days (day null)."""
    found = digests.percentiles(stored(_requests(spark, d), "requests"), ["run_id", "day"], METRICS, union_keys=[["run_id"]])
    own, union = found["run_id,day"], found["run_id"].withColumn("day", F.lit(None).cast("date"))
    return own.unionByName(union)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "sft_examples"))


def p5_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"))


def p5_sources(spark: SparkSession, d: str) -> DataFrame:
    """The same with at most one text of each source in a sequence."""
    return packing.packed(table(spark, d, "documents"), one_of_source=True)


def p5_padding(spark: SparkSession, d: str) -> DataFrame:
    return packing.padding(packing.packed(table(spark, d, "documents")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), item_texts(spark, d))


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 13 words with up to two characters changed, left out or put in."""
    return leaks.leaks(table(spark, d, "documents"), item_texts(spark, d), q=12, edits=2)


def item_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", F.explode(F.array("question", "target")).alias("text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.pairs(table(spark, d, "documents"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shares(table(spark, d, "documents"))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    return spans.doc_classes(table(spark, d, "documents"))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Every text without the sentences that an earlier document has in a common passage."""
    return spans.first_only(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_counts, p2_found, p2_shares, p3_percentiles, p4_found, p5_packed, p5_padding, p5_sources, p6_found, p6_near, p7_found, p7_shares, p7_classes, p7_kept]
    return {f.__name__: f for f in own}


# each document's places at which 200 characters stand that another document holds too, or one of a smaller id; least(200, ...) adds up their union
_PLACES = """with t as (
  select doc_id, i, md5(substr(text, i, 200)) as g from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from documents where length(text) >= 200)
), g as (select g, min(doc_id) as lo from t group by g having min(doc_id) < max(doc_id))"""
_SPANS = """, p as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) > 200 as gap from t join g using (g) where lo < doc_id),
s as (select doc_id, i, sum(case when gap then 1 else 0 end) over (partition by doc_id order by i) as island from p), o as (select doc_id, min(i) as a, max(i) + 200 as e from s group by doc_id, island)"""

_CANONICAL = r"lower(upper(regexp_replace(nfc_normalize(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', '', 'g')))"
_KEYS = (
    r"""with chat as (
  select row_id, prompt,
    list_filter(chosen, lambda m: m.role = 'assistant')[1].content as chosen,
    list_filter(rejected, lambda m: m.role = 'assistant')[1].content as rejected
  from clipped_completions
), sides as (
  select row_id, raw ->> '$.prompt' as prompt, raw -> '$.chosen' as c, raw -> '$.rejected' as r from clipped_raw
), lists as (
  select row_id, prompt,
    case when json_type(c) = 'ARRAY' then list_filter(from_json(c, '[{"content":"VARCHAR","role":"VARCHAR"}]'), lambda m: m.role = 'assistant')[1].content else c ->> '$' end as chosen,
    case when json_type(r) = 'ARRAY' then list_filter(from_json(r, '[{"content":"VARCHAR","role":"VARCHAR"}]'), lambda m: m.role = 'assistant')[1].content else r ->> '$' end as rejected
  from sides
), keyed as (
  select row_id, """
    + " || '|' || ".join(_CANONICAL.format(f) for f in ("prompt", "chosen", "rejected"))
    + """ as k from (select * from chat union all select * from lists)
)"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _KEYS + " select f.record_id, row_id as copy_id from keyed join (select k, min(row_id) as record_id from keyed group by k) f using (k) where row_id <> f.record_id",
        "p1_counts": _KEYS + " select min(row_id) as record_id, count(*)::bigint as copies, false as collided from keyed group by k",
        "p6_found": r"""with w as (
  select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from documents where text is not null
), d as (
  select doc_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) as g from w where len(ws) >= 13
), v as (
  select item_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') as ws from (select item_id, unnest([question, target]) as t from eval_items)
), e as (
  select item_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) as g from v where len(ws) >= 13
) select distinct item_id, doc_id from d join e using (g)""",
        "p7_shares": _PLACES + """, p as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from t join g using (g)), c as (select doc_id, sum(least(200, coalesce(i - before, 200)))::bigint as shared_chars from p group by 1)
select doc_id, length(text)::bigint as n_chars, shared_chars, shared_chars / length(text) as share from c join documents using (doc_id)""",
        "p7_kept": _PLACES + _SPANS + r""", b as (select doc_id, text, list_filter(range(2, length(text) + 1), lambda i: text[i - 1] = chr(10) or text[i - 1] = ' ' and text[i - 2] in ('.', '!', '?')) as starts from documents where text is not null),
n as (select doc_id, text, unnest([1] || starts) as a, unnest(starts || [length(text) + 1]) as e from b where text <> ''),
k as (select n.doc_id, n.a, n.e, substr(n.text, n.a, n.e - n.a) as part, bool_or(coalesce(o.a <= n.a and o.e >= n.e, false)) as gone from n left join o on n.doc_id = o.doc_id group by all),
r as (select doc_id, count(*) as sentences, count_if(gone) as removed, coalesce(string_agg(part, '' order by a) filter (where not gone), '') as text from k group by 1)
select d.doc_id, length(d.text)::bigint as n_chars, coalesce(sentences, 0)::int as sentences, coalesce(removed, 0)::int as removed, coalesce(r.text, '') as text from documents d left join r using (doc_id) where d.text is not null""",
        "p7_found": """with t as (
  select doc_id, unnest(list_transform(range(1, length(text) - 198), lambda i: md5(substr(text, i, 200)))) as g from documents where length(text) >= 200
), u as (select distinct doc_id, g from t), m as (select g from u group by g having count(*) > 1), r as (select u.doc_id, u.g from u join m using (g))
select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from r a join r b on a.g = b.g and a.doc_id < b.doc_id""",
    }
