"""The test tables in the shapes that the operators take. Each has the same definition in SQL, as text to put before a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import SPACE
from millrace.session import table

STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+|[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+$', '', 'g')"


def strip_sql(x: str) -> str:
    """py_strip in DuckDB."""
    return STRIP.format(x)


def char4_sql(x: str) -> str:
    return f"greatest(1, length({strip_sql(x)}) // 4)"


#: What summaries need of a request.
SUMMARY = ("arrival_time", "queue_wait_ms", "ttft_ms", "e2e_latency_ms", "status_code", "completion_tokens", "stream_status")


def requests(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Request records, each once, with the run's regime, mode, seed and rate; of the records only the named columns, by default those of summaries.

    A second delivery differs in recorded_at only, so rows without it are distinct requests, and only what a query needs is read and sent."""
    rows = table(spark, d, "gateway_requests").select("request_id", "run_id", *(columns or SUMMARY)).distinct()
    return rows.join(table(spark, d, "benchmark_runs"), "run_id")


REQUESTS = """requests as (
  select * from (select distinct request_id, run_id, arrival_time, queue_wait_ms, ttft_ms, e2e_latency_ms, status_code, admitted, shed_reason, completion_tokens, client_disconnected, stream_status from gateway_requests) join benchmark_runs using (run_id)
)"""


def lengths(spark: SparkSession, d: str) -> DataFrame:
    """ordinal, len: estimated tokens of each document."""
    from millrace.functions.text import tokens_quarter

    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("ordinal"), tokens_quarter(F.col("text")).alias("len"))


LENGTHS = f"lengths as (select doc_id as ordinal, ({char4_sql('text')})::int as len from documents where text is not null)"


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    """batch, grp, k, reward: purchases and clicks of a day as rewards of a user's group."""
    e = table(spark, d, "events")
    reward = F.when(F.col("event_type") == "purchase", 1.5).when(F.col("event_type") == "click", 0.5).otherwise(0.0)
    return e.select(F.to_date("ts").alias("batch"), F.col("user_id").alias("grp"), F.col("event_id").alias("k"), reward.alias("reward"))


ROLLOUTS = "rollouts as (select ts::date as batch, user_id as grp, event_id as k, case event_type when 'purchase' then 1.5::double when 'click' then 0.5::double else 0.0::double end as reward from events)"


def steps(spark: SparkSession, d: str) -> DataFrame:
    """run, step, format_reward, accuracy_reward, validation_accuracy: shares of event types by user class and day."""
    e = table(spark, d, "events").groupBy((F.col("user_id") % 4).cast("int").alias("run"), F.to_date("ts").alias("day"))
    share = lambda kind: F.count_if(F.col("event_type") == kind) / F.count(F.lit(1))
    daily = e.agg(share("click").alias("format_reward"), share("purchase").alias("accuracy_reward"), share("view").alias("validation_accuracy"))
    return daily.select("run", F.row_number().over(Window.partitionBy("run").orderBy("day")).alias("step"), "format_reward", "accuracy_reward", "validation_accuracy")


STEPS = """steps as (
  select run, row_number() over (partition by run order by day)::int as step, format_reward, accuracy_reward, validation_accuracy from (
    select (user_id % 4)::int as run, ts::date as day, count_if(event_type = 'click') / count(*) as format_reward, count_if(event_type = 'purchase') / count(*) as accuracy_reward, count_if(event_type = 'view') / count(*) as validation_accuracy from events group by 1, 2)
)"""


def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    """row_id, prompt, chosen, rejected (message lists), score_chosen, score_rejected."""
    return table(spark, d, "clipped_completions").select("row_id", "prompt", "chosen", "rejected", "score_chosen", "score_rejected")


def space() -> str:
    return SPACE
