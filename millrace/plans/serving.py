"""Queries V1-V23, A1-A8, J6, J7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.stats import exact_percentiles
from millrace.operators import admission, arrivals, policies
from millrace.operators import requests as V
from millrace.plans import adapters as A
from millrace.plans.preflight import r6
from millrace.plans.registry import query
from millrace.session import table

_CLASSES = """classes as (
  select *, coalesce(stream_status = 'COMPLETED' and status_code = 200, false) as completed, coalesce(stream_status = 'TRUNCATED', false) as truncated, coalesce(stream_status = 'SHED' or status_code = 429, false) as shed,
    coalesce(stream_status = 'CANCELLED', false) as cancelled, coalesce(stream_status = 'UNFINISHED', false) as unfinished from requests
), flags as (select *, not (completed or truncated or shed or cancelled or unfinished) as errored from classes)"""
_COUNTS = """count(*) as offered, count_if(not shed) as admitted, count_if(truncated) + count_if(errored) + count_if(cancelled) + count_if(unfinished) as failed, count_if(completed) as completed, count_if(truncated) as truncated, count_if(shed) as shed,
  count_if(cancelled) as cancelled, count_if(unfinished) as unfinished, count_if(errored) as errored"""


def _q(name: str, x: str) -> str:
    return ", ".join(f"round(coalesce(quantile_cont({x}, {q}), 0), 6) as {name}_{p}" for p, q in V.QUANTILES.items())


_LAT = ", ".join([_q("ttft", "case when completed and ttft_ms > 0 then ttft_ms end"), _q("e2e", "case when completed then e2e_latency_ms end"), _q("wait", "case when queue_wait_ms > 0 then queue_wait_ms end")])
_WINDOW = "nullif(max(arrival_time) - min(arrival_time), 0)"
_RATES = f"""round(count_if(completed) / {_WINDOW}, 6) as completed_per_s, round(sum(case when completed then completion_tokens end) / {_WINDOW}, 6) as tokens_per_s, round(count_if(completed and e2e_latency_ms <= 2500) / count(*), 6) as attainment,
  round(count_if(coalesce(completed and e2e_latency_ms <= 2500 and ttft_ms <= 250, false)) / {_WINDOW}, 6) as goodput"""
_BASE = f"with {A.REQUESTS}, {_CLASSES}"
_RUN = f"runs as (select regime, mode, seed, {_COUNTS}, {_LAT}, {_RATES} from flags group by all)"
MEASURES = ["attainment", "goodput", "ttft_p99", "e2e_p99", "shed"]


@query("v1_classes", f"{_BASE} select request_id, completed, truncated, shed, cancelled, unfinished, errored from flags")
def v1_classes(spark: SparkSession, d: str) -> DataFrame:
    return V.classified(A.requests(spark, d, "status_code", "stream_status")).select("request_id", "completed", "truncated", "shed", "cancelled", "unfinished", "errored")


@query("v16_mode_comparison", f"{_BASE} select mode, {_COUNTS}, {_LAT}, {_RATES} from flags group by mode")
def v16_mode_comparison(spark: SparkSession, d: str) -> DataFrame:
    """V1-V7 by mode."""
    return r6(V.summary(A.requests(spark, d), ["mode"]))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return V.summary(A.requests(spark, d), ["regime", "mode", "seed"])


def _long(keys: str, source: str) -> str:
    parts = " union all ".join(f"select {keys}, '{m}' as measure, {m}::double as v from {source}" for m in MEASURES)
    return f"select {keys}, measure, count(v) as runs, round(avg(v), 4) as mean, round(case when count(v) = 1 then 0 else stddev_samp(v) end, 4) as std from ({parts}) group by all"


@query("v18_campaign", f"{_BASE}, {_RUN} {_long('regime, mode', 'runs')}")
def v18_campaign(spark: SparkSession, d: str) -> DataFrame:
    """Two levels, run by run and then over seeds."""
    out = V.across_runs(r6(runs(spark, d)), ["regime", "mode"], MEASURES)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query("v18_unbalanced", f"{_BASE}, {_RUN} select regime, mode, seed, offered from runs where completed + shed + failed <> offered")
def v18_unbalanced(spark: SparkSession, d: str) -> DataFrame:
    """The accounting check."""
    return V.unbalanced(runs(spark, d)).select("regime", "mode", "seed", "offered")


@query("v3_selected", f"{_BASE} select mode, count(*) as n, round(quantile_cont(e2e_latency_ms, 0.5), 6) as p50, round(quantile_cont(e2e_latency_ms, 0.9), 6) as p90, round(quantile_cont(e2e_latency_ms, 0.95), 6) as p95, round(quantile_cont(e2e_latency_ms, 0.99), 6) as p99 from flags where completed group by mode")
def v3_selected(spark: SparkSession, d: str) -> DataFrame:
    """V3 for groups of any size."""
    rows = V.classified(A.requests(spark, d, "e2e_latency_ms", "status_code", "stream_status")).where("completed")
    out = exact_percentiles(rows, ["mode"], {"x": F.col("e2e_latency_ms")}, tuple(V.QUANTILES.values()))
    return r6(out.select("mode", F.col("x_n").alias("n"), *[F.col("x")[k].alias(p) for k, p in enumerate(V.QUANTILES)]))


@query("v5_run_rates", f"{_BASE} select run_id, {_RATES} from flags group by run_id")
def v5_run_rates(spark: SparkSession, d: str) -> DataFrame:
    """V5-V7 by run."""
    return r6(V.classified(A.requests(spark, d)).groupBy("run_id").agg(*V.rates()))


@query("v8_gaps", "select request_id, round(coalesce(list_avg(inter_event_latencies_ms), 0), 6) as tpot_ms, round(coalesce(list_stddev_pop(inter_event_latencies_ms), 0), 6) as jitter_ms from (select request_id, any_value(inter_event_latencies_ms) as inter_event_latencies_ms from gateway_requests group by request_id)")
def v8_gaps(spark: SparkSession, d: str) -> DataFrame:
    """V8 from arrays."""
    rows = V.gap_stats(table(spark, d, "gateway_requests"), "inter_event_latencies_ms").select("request_id", "tpot_ms", "jitter_ms")
    return r6(rows.groupBy("request_id").agg(F.any_value("tpot_ms").alias("tpot_ms"), F.any_value("jitter_ms").alias("jitter_ms")))  # after the statistics, so two numbers are sent in place of an array


_EV = "e as (select user_id as request_id, epoch(ts) as at_s, event_type <> 'signup' as content from events), s as (select request_id, min(at_s) as start_s, max(at_s) as last from e group by 1), g as (select request_id, at_s, at_s - lag(at_s) over (partition by request_id order by at_s) as gap from e where content), a as (select request_id, min(at_s) as first, coalesce(avg(gap), 0) as tpot_s, coalesce(stddev_pop(gap), 0) * 1000 as jitter_ms, count(*) as n_events from g group by 1)"


@query("v8_token_times", f"with {_EV} select request_id, round(coalesce(first, last) - start_s, 4) as ttft_s, round(coalesce(tpot_s, 0), 4) as tpot_s, round(coalesce(jitter_ms, 0), 1) as jitter_ms, coalesce(n_events, 0) as n_events from s left join a using (request_id)")
def v8_token_times(spark: SparkSession, d: str) -> DataFrame:
    """V8 from event times: a user's events as a stream."""
    e = table(spark, d, "events").select(F.col("user_id").alias("request_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_s"), (F.col("event_type") != "signup").alias("content"))
    e = e.join(e.groupBy("request_id").agg(F.min("at_s").alias("start_s")), "request_id")
    t = V.token_times(e)
    return t.select("request_id", F.round("ttft_s", 4).alias("ttft_s"), F.round("tpot_s", 4).alias("tpot_s"), F.round("jitter_ms", 1).alias("jitter_ms"), "n_events")


@query("v9_schedule_relative", f"with {A.REQUESTS} select request_id, round((arrival_time - floor(arrival_time)) * 1000, 3) as lag_ms, round(ttft_ms + (arrival_time - floor(arrival_time)) * 1000, 3) as ttft_scheduled_ms, round(e2e_latency_ms + (arrival_time - floor(arrival_time)) * 1000, 3) as e2e_scheduled_ms from requests")
def v9_schedule_relative(spark: SparkSession, d: str) -> DataFrame:
    rows = A.requests(spark, d, "arrival_time", "ttft_ms", "e2e_latency_ms").withColumns({"dispatched_s": F.col("arrival_time"), "scheduled_s": F.floor("arrival_time").cast("double")})
    return V.schedule_relative(rows).select("request_id", *[F.round(c, 3).alias(c) for c in ("lag_ms", "ttft_scheduled_ms", "e2e_scheduled_ms")])


@query("v10_terminal", "with s as (select user_id as request_id, bool_or(event_type = 'purchase') as done, bool_or(event_type = 'error') as gone from events group by 1) select request_id, case when done then 'COMPLETED' when gone then 'CANCELLED' else 'TRUNCATED' end as status, case when done then 200 when gone then 499 else 502 end as code from s")
def v10_terminal(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("request_id"), F.when(F.col("event_type") == "purchase", "[DONE]").otherwise("{}").alias("payload"), (F.col("event_type") == "error").alias("disconnected"))
    return V.terminal_status(e)


_OK = "admitted and status_code = 200 and not coalesce(client_disconnected, false)"


def _g(n: str, x: str) -> str:
    return ", ".join(f"round(coalesce(quantile_cont({x}, {q}), 0), 6) as {n}_{p}" for p, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))


_GTTFT = f"case when {_OK} and ttft_ms > 0 then ttft_ms end"
_GE2E = f"case when {_OK} then e2e_latency_ms end"


@query("v11_gateway", f"with {A.REQUESTS} select run_id, count(*) as total, count_if({_OK}) as completed, count_if(not admitted) as shed, {_g('ttft', _GTTFT)}, {_g('e2e', _GE2E)}, coalesce(sum(case when {_OK} then completion_tokens end), 0)::bigint as tokens from requests group by run_id")
def v11_gateway(spark: SparkSession, d: str) -> DataFrame:
    return r6(V.gateway_summary(A.requests(spark, d, "ttft_ms", "e2e_latency_ms", "status_code", "admitted", "completion_tokens", "client_disconnected"), ["run_id"]))


@query("v19_capacity", f"{_BASE}, a as (select mode, target_rps, count_if(completed and e2e_latency_ms <= 2500) / count(*) as att from flags group by all) select mode, coalesce(max_by(target_rps, target_rps) filter (where att >= 0.85), min(target_rps)) as capacity, min(target_rps) filter (where att < 0.85) as first_failure from a group by mode")
def v19_capacity(spark: SparkSession, d: str) -> DataFrame:
    sweep = V.classified(A.requests(spark, d)).groupBy("mode", "target_rps").agg(*V.rates())
    return V.capacity(sweep, ["mode"], "target_rps", "target_rps", "attainment", 0.85)


_SINCE = "since as (select *, arrival_time - min(arrival_time) over (partition by run_id) as since_s from flags)"


@query("v21_phases", f"{_BASE}, {_SINCE} select mode, case when since_s < 1000000 then 'early' when since_s < 3000000 then 'transition' else 'steady' end as phase, count(*) as n, count_if(completed) as completed, round(avg(case when completed then e2e_latency_ms end), 6) as e2e, round(avg(case when completed then tpot end), 6) as tpot_ms from since join (select request_id, coalesce(list_avg(any_value(inter_event_latencies_ms)), 0) as tpot from gateway_requests group by 1) using (request_id) group by all")
def v21_phases(spark: SparkSession, d: str) -> DataFrame:
    rows = V.classified(A.requests(spark, d, "arrival_time", "e2e_latency_ms", "status_code", "stream_status"))
    first = rows.groupBy("run_id").agg(F.min("arrival_time").alias("first"))
    gaps = V.gap_stats(table(spark, d, "gateway_requests"), "inter_event_latencies_ms").groupBy("request_id").agg(F.any_value("tpot_ms").alias("tpot_ms"))
    rows = rows.join(first, "run_id").join(gaps, "request_id").withColumn("since_s", F.col("arrival_time") - F.col("first"))
    return r6(rows.groupBy("mode", V.phases(rows, 1e6, 3e6).alias("phase")).agg(F.count(F.lit(1)).alias("n"), F.count_if("completed").alias("completed"), F.avg(F.when(F.col("completed"), F.col("e2e_latency_ms"))).alias("e2e"), F.avg(F.when(F.col("completed"), F.col("tpot_ms"))).alias("tpot_ms")))


@query("v22_forwarding", f"{_BASE} select regime, round(quantile_cont(case when mode = 'direct' then ttft_ms end, 0.5), 6) as direct_p50, round(quantile_cont(case when mode = 'passthrough' then ttft_ms end, 0.5), 6) as forwarded_p50, round(quantile_cont(case when mode = 'passthrough' then ttft_ms end, 0.5) - quantile_cont(case when mode = 'direct' then ttft_ms end, 0.5), 6) as delta from flags where completed group by regime")
def v22_forwarding(spark: SparkSession, d: str) -> DataFrame:
    rows = V.classified(A.requests(spark, d, "ttft_ms", "status_code", "stream_status")).where("completed")
    return r6(V.forwarding_delta(rows, ["regime"], "mode", "direct", "passthrough", "ttft_ms"))


@query("v23_concurrency", "select run_id, ceil(target_rps * 1.25)::bigint as cap from benchmark_runs")
def v23_concurrency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark_runs").select("run_id", V.concurrency(F.col("target_rps"), F.lit(1.25)).cast("long").alias("cap"))


@query("j6_paired", f"{_BASE}, {_RUN} select regime, seed, round(b.attainment - a.attainment, 6) + 0.0 as attainment, round(b.e2e_p99 - a.e2e_p99, 6) + 0.0 as e2e_p99 from (select * from runs where mode = 'direct') a join (select * from runs where mode = 'bounded_queue') b using (regime, seed)")
def j6_paired(spark: SparkSession, d: str) -> DataFrame:
    return r6(V.paired(r6(runs(spark, d)), ["regime", "seed"], "mode", "direct", "bounded_queue", ["attainment", "e2e_p99"]))


@query("j7_gateway", "select c.request_id, count(g.request_id) as deliveries, max(g.status_code) as gateway_status from (select distinct request_id from gateway_requests) c left join (select * from gateway_requests where admitted) g using (request_id) group by 1")
def j7_gateway(spark: SparkSession, d: str) -> DataFrame:
    """All requests with the records of those admitted."""
    g = table(spark, d, "gateway_requests")
    both = V.with_gateway(g.select("request_id").distinct(), g.where("admitted").select("request_id", "status_code"))
    return both.groupBy("request_id").agg(F.count("gateway_status_code").alias("deliveries"), F.max("gateway_status_code").alias("gateway_status"))


@query("v12_schedules")
def v12_schedules(spark: SparkSession, d: str) -> DataFrame:
    """V12-V14."""
    rows = [("count", t) for t in arrivals.poisson_count(200, 10.0)] + [("window", t) for t in arrivals.poisson_window(20.0, 10.0)] + [("burst", t) for t in arrivals.burst(40.0, 5.0, 40.0)]
    return spark.createDataFrame(rows, "schedule string, at_s double").groupBy("schedule").agg(F.count(F.lit(1)).alias("n"), F.min("at_s").alias("first"), F.max("at_s").alias("last"))


@query("a1_replay")
def a1_replay(spark: SparkSession, d: str) -> DataFrame:
    """A1: each run's trace, sped up, through a bounded queue."""
    trace = A.requests(spark, d, "arrival_time", "e2e_latency_ms").select("run_id", "request_id", (F.col("arrival_time") / 3000).alias("at_s"), (F.col("e2e_latency_ms") / 1000).alias("service_s"))
    out = admission.replayed(trace, "run_id", "bounded_queue", 4, 4, 0.25)
    return r6(out.groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("n"), F.avg("wait_s").alias("wait_s")))


@query("a1_static")
def a1_static(spark: SparkSession, d: str) -> DataFrame:
    """A1: the same with a fixed cap."""
    trace = A.requests(spark, d, "arrival_time", "e2e_latency_ms").select("run_id", "request_id", (F.col("arrival_time") / 3000).alias("at_s"), (F.col("e2e_latency_ms") / 1000).alias("service_s"))
    return admission.replayed(trace, "run_id", "static", 4).groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("a2_shed", "select request_id, case when queue_wait_ms <= 50 then 200 else 429 end as code, case when queue_wait_ms > 50 then 15 end as retry_s from gateway_requests")
def a2_shed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gateway_requests").select("request_id", policies.shed_by_delay(F.col("queue_wait_ms"), 50.0).alias("x")).select("request_id", "x.*")


def _hits(xs: list[str], w: str) -> str:
    return f"len(list_intersect({w}, [{', '.join(repr(x) for x in xs)}]))"


_W = r"regexp_extract_all(lower(prompt), '[\p{L}\p{N}_]+')"


@query("a3_cascade", f"with w as (select example_id, example_id % 2 = 0 as sat, {_W} as w from sft_examples where prompt is not null), h as (select *, {_hits(policies.REASONING, 'w')} > 0 as hard, len(w) > 24 as long from w) select example_id, case when (not sat and (hard or long)) or (sat and hard) then 'deep' else 'fast' end as lane, sat and not hard and not long as spill from h")
def a3_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sft_examples").where("prompt is not null")
    return rows.select("example_id", policies.cascade(F.col("prompt"), F.col("example_id") % 2 == 0, 24).alias("x")).select("example_id", "x.*")


@query(
    "a4_nearest_task",
    f"""with w as (select example_id, list_distinct({_W}) as w from sft_examples where prompt is not null), s as (select *, greatest(len(w), 1)::double as n, {_hits(policies.CENTROIDS['conversational'], 'w')} as a, {_hits(policies.CENTROIDS['mathematical'], 'w')} as b, {_hits(policies.CENTROIDS['code'], 'w')} as c, {_hits(policies.DECISIVE, 'w')} > 0 as dec from w),
t as (select *, greatest(a, b, c) as best, case when a >= b and a >= c then 'conversational' when b >= c then 'mathematical' else 'code' end as name from s)
select example_id, case when (name <> 'conversational' or dec) and best = 0 then 'code' when not (name <> 'conversational' or dec) then 'conversational' else name end as task, case when name <> 'conversational' or dec then 'deep' else 'fast' end as lane, round(case when best > 0 then best / n else 0.85 end, 6) as score from t""",
)
def a4_nearest_task(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sft_examples").where("prompt is not null")
    return r6(rows.select("example_id", policies.nearest_task(F.col("prompt")).alias("x")).select("example_id", "x.*"))


@query("a5_pods", "select run_id, (('0x' || md5(run_id))::uhugeint % 7)::int as pod from benchmark_runs")
def a5_pods(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark_runs").select("run_id", policies.pod_of(F.col("run_id"), 7).alias("pod"))


@query("a7_quota", "select user_id, count(*)::bigint as asked, least(15, count(*))::bigint as live from events group by 1")
def a7_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.lit(1).cast("long").alias("blocks"))
    return policies.tenant_quota(rows, "user_id", "blocks", 100).select("user_id", "asked", F.col("live").cast("long").alias("live"))


@query("a7_survivors", "select event_id, user_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 15")
def a7_survivors(spark: SparkSession, d: str) -> DataFrame:
    return policies.surviving_blocks(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], 100).select("event_id", "user_id")


@query("a8_leaks", "with x as (select event_id, (event_id % 3)::int as active, (value * 4)::int as used from events), y as (select *, case when active > 0 then 0 else greatest(0, used - 120) end as residual from x) select event_id, residual::int as residual, round(residual / 2000 * 100, 6) as pct, case when active <= 0 and residual >= 300 then 503 else 200 end as code from y")
def a8_leaks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 3).cast("int").alias("active"), F.round(F.col("value") * 4).cast("int").alias("used"))
    return r6(rows.select("event_id", policies.leak_watch(F.col("active"), F.col("used")).alias("x")).select("event_id", "x.*"))


@query("a6_primed", "select run_id, (('0x' || md5(run_id))::uhugeint % 4)::int as pod, 2500 as tokens, 120.0::double as ms from benchmark_runs")
def a6_primed(spark: SparkSession, d: str) -> DataFrame:
    return policies.primed(table(spark, d, "benchmark_runs").select("run_id"), "run_id", 4)


@query("a9_handoff", "select * from (values " + ", ".join(f"({a}::double, {b}, {c}, {e}::double, {f}::double, {g})" for a, b, c, e, f, g in policies.HANDOFF) + ") t(at_s, spot, anchor, boot_pct, absorbed_pct, dropped)")
def a9_handoff(spark: SparkSession, d: str) -> DataFrame:
    return policies.handoff(spark)


@query("a10_flags", "select run_id, '--model-size ' || model_size || ' --seed ' || seed || case when mode <> 'direct' then ' --enable-gateway' else '' end as flags from benchmark_runs")
def a10_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark_runs").select("run_id", "model_size", "seed", (F.col("mode") != "direct").alias("enable_gateway"))
    return rows.select("run_id", F.array_join(policies.command_flags(rows, ["model_size", "seed", "enable_gateway"]), " ").alias("flags"))
