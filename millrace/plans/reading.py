"""Queries S1-S19 over texts made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import arrivals
from millrace.operators import requests as V
from millrace.plans import adapters as A
from millrace.plans.adapters import strip_sql
from millrace.plans.preflight import r6
from millrace.plans.registry import query
from millrace.session import shared_path, table
from millrace.sources import jsonl, sse, telemetry


@query("s1_parsed", "select row_id % 4 as kind, count(*) as n, count_if(row_id % 4 <> 3) as valid from clipped_raw group by 1")
def s1_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Whole lines, lines with a comma at the end, which repair mends, and lines cut in two."""
    k = F.col("row_id") % 4
    line = F.when(k == 1, F.concat("raw", F.lit(",,"))).when(k == 3, F.substring(F.col("raw"), 1, 40)).otherwise(F.concat(F.lit("  "), "raw", F.lit("\t")))
    rows = table(spark, d, "clipped_raw").select("row_id", F.when(k == 1, F.concat(F.lit('{"a": "'), F.col("row_id").cast("string"), F.lit('"},,'))).otherwise(line).alias("value"))
    return jsonl.parsed(rows).groupBy((F.col("row_id") % 4).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("valid"))


@query("s3_pairs", "select row_id, raw ->> '$.prompt' as prompt, raw ->> '$.score_chosen' is not null as scored, json_type(raw, '$.chosen') = 'ARRAY' as listed from clipped_raw")
def s3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """S3."""
    rows = jsonl.parsed(table(spark, d, "clipped_raw").select("row_id", F.col("raw").alias("value")), schema=jsonl.PAIR, repair=False).where("valid")
    return rows.select("row_id", "row.prompt", F.col("row.score_chosen").isNotNull().alias("scored"), F.startswith("row.chosen", F.lit("[{")).alias("listed"))


@query("s3_sides", "select row_id, case when json_type(raw, '$.chosen') = 'ARRAY' then json_array_length(raw, '$.chosen') else 1 end::int as messages from clipped_raw")
def s3_sides(spark: SparkSession, d: str) -> DataFrame:
    rows = jsonl.parsed(table(spark, d, "clipped_raw").select("row_id", F.col("raw").alias("value")), schema=jsonl.PAIR, repair=False).select("row_id", "row.*")
    return jsonl.sides_of_json(rows).select("row_id", F.size("chosen").alias("messages"))


@query("s6_head", "select doc_id, lang from documents order by doc_id limit 100")
def s6_head(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.head(table(spark, d, "documents"), "doc_id", 100, ["doc_id", "lang"])


@query("s7_prompts", "select prompt from sft_examples where prompt <> '' order by example_id limit 50")
def s7_prompts(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.prompts(table(spark, d, "sft_examples").select("example_id", "prompt"), 50, "example_id")


@query("s9_trace")
def s9_trace(spark: SparkSession, d: str) -> DataFrame:
    """S8 and S9."""
    return arrivals.generated_trace(spark, 2000, 10.0, ["Explain a queue.", "Describe a cache.", "Compare two schedulers."])


@query("s10_math", "select item_id, 'Question: ' || question || chr(10) || 'Answer:' as prompt, trim(string_split(target, '####')[-1]) as target from eval_items where item_id >= 20")
def s10_math(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.math_split(table(spark, d, "eval_items").withColumnRenamed("target", "answer"), "item_id", 20)


def stream_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a stream whose events are split between two chunks."""
    e = table(spark, d, "events")
    payload = F.when(F.col("event_type") == "purchase", F.lit("[DONE]")).otherwise(F.concat(F.lit('{"choices":[{"delta":{"content":"'), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")), F.lit('"}}]}')))
    text = F.concat(F.lit("data: "), payload, F.lit("\r\n\r\n"))
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    two = F.array(F.struct((F.col("event_id") * 2).alias("seq"), F.substring(text, 1, 9).alias("chunk")), F.struct((F.col("event_id") * 2 + 1).alias("seq"), F.substring(text, 10, 10_000).alias("chunk")))
    return e.select(F.col("user_id").alias("request_id"), at.alias("at_s"), F.explode(two).alias("x")).select("request_id", "x.seq", "x.chunk", "at_s")


@query("s11_events", "select user_id as request_id, (row_number() over (partition by user_id order by event_id) - 1)::int as event, event_type = 'purchase' as done, event_type not in ('purchase', 'view') as content, round(epoch(ts), 3) as at_s from events")
def s11_events(spark: SparkSession, d: str) -> DataFrame:
    """S11 and S12."""
    return sse.events(stream_chunks(spark, d)).select("request_id", "event", "done", "content", F.round("at_s", 3).alias("at_s"))


@query("s13_metrics", "select event_id, 'requests_' || event_type as metric, (user_id)::varchar as pool, round(value, 6) as number from events where event_type <> 'error'")
def s13_metrics(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("event_type") == "error", "# HELP requests").otherwise(F.format_string('requests_%s{pool="%s",zone="a"} %s', "event_type", F.col("user_id").cast("string"), F.col("value").cast("string")))
    rows = telemetry.metrics(table(spark, d, "events").select("event_id", line.alias("value")))
    return r6(rows.select("event_id", "metric", F.col("labels")["pool"].alias("pool"), "number"))


@query("s18_markdown", f"with {A.REQUESTS} select '| ' || mode || ' | ' || format('{{:.2f}} ± {{:.2f}}', avg(e2e_latency_ms), stddev_samp(e2e_latency_ms)) || ' |' as line from requests group by mode")
def s18_markdown(spark: SparkSession, d: str) -> DataFrame:
    """S17 and S18."""
    rows = A.requests(spark, d, "e2e_latency_ms").groupBy("mode").agg(F.avg("e2e_latency_ms").alias("m"), F.stddev_samp("e2e_latency_ms").alias("s"))
    return telemetry.markdown_rows(rows, "mode", [("m", "s")])


@query("s19_newest", "select event_id from events qualify row_number() over (partition by user_id order by event_id desc) <= 5")
def s19_newest(spark: SparkSession, d: str) -> DataFrame:
    return V.newest(table(spark, d, "events"), "event_id", 5, ["user_id"]).select("event_id")


_KEY = f"lower({strip_sql('prompt')})"


@query("j5_duplicates", f"select example_id, row_number() over (partition by {_KEY} order by example_id) > 1 as duplicate from sft_examples where {_KEY} <> ''")
def j5_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose prompt came before; first rows by key from an aggregate, not from a window over a key's rows. Every prompt that isn't null or blank has a row."""
    from millrace.functions.text import normal_key

    rows = table(spark, d, "sft_examples").select("example_id", normal_key(F.col("prompt")).alias("key")).where("key <> ''")
    first = rows.groupBy("key").agg(F.min("example_id").alias("first"))
    return rows.join(first, "key").select("example_id", (F.col("example_id") != F.col("first")).alias("duplicate"))


@query("s8_trace", "select 'r' || event_id as request_id, 'events' as source, (user_id)::varchar as source_id, event_type as workload_class, 1 as messages, (event_id % 90 + 1)::int as prompt_tokens, 64 as max_tokens, round(event_id * 0.25::double, 2) as arrival_offset_s from events")
def s8_trace(spark: SparkSession, d: str) -> DataFrame:
    """A trace written and read again."""
    one = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("Say "), "event_type").alias("content")))
    rows = table(spark, d, "events").select(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"), F.lit("events").alias("source"), F.col("user_id").cast("string").alias("source_id"), F.col("event_type").alias("workload_class"), one.alias("messages"), (F.col("event_id") % 90 + 1).cast("int").alias("prompt_tokens"), F.lit(64).alias("max_tokens"), (F.col("event_id") * 0.25).alias("arrival_offset_s"))
    path = shared_path(spark, "trace")
    jsonl.write_trace(rows, path)
    return jsonl.read_trace(spark, path).withColumns({"messages": F.size("messages"), "arrival_offset_s": F.round("arrival_offset_s", 2)})


@query("s14_samples", "select event_id::varchar as ts, 'P' || event_id % 9 as pstate, case when event_id % 7 = 0 then null else (event_id % 90)::double end as temperature, round(value, 2) as power, 0.0::double as utilisation, 0.0::double as memory_utilisation, (user_id)::double as memory_used, 1.0::double as sm_clock, 2.0::double as memory_clock from events where event_id % 5 <> 0")
def s14_samples(spark: SparkSession, d: str) -> DataFrame:
    """A sampler's lines, of which every fifth is cut short and some values aren't supported."""
    k, text = F.col("event_id"), lambda c: c.cast("string")
    heat = F.when(k % 7 == 0, "[Not Supported]").otherwise(text(k % 90))
    whole = F.concat_ws(", ", text(k), F.concat(F.lit("P"), text(k % 9)), heat, F.format_string("%.2f W", "value"), F.lit("0 %"), F.lit("0 %"), F.concat(text(F.col("user_id")), F.lit(" MiB")), F.lit("1 MHz"), F.lit("2 MHz"))
    path = shared_path(spark, "samples")
    table(spark, d, "events").select(F.when(k % 5 == 0, F.concat_ws(", ", text(k), F.lit("P0"))).otherwise(whole).alias("value")).write.text(path)
    return telemetry.device_samples(spark, path)


@query("s17_report", f"with {A.REQUESTS} select mode, count(*) as n, round(avg(e2e_latency_ms), 4) as mean_ms from requests group by mode")
def s17_report(spark: SparkSession, d: str) -> DataFrame:
    """A report written and read again."""
    path = shared_path(spark, "report")
    telemetry.write_report(A.requests(spark, d, "e2e_latency_ms").groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e2e_latency_ms"), 4).alias("mean_ms")), path)
    return spark.read.schema("mode string, n long, mean_ms double").json(path)
