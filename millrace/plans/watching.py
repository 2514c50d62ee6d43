"""Queries M1-M13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import monitors as M
from millrace.plans import adapters as A
from millrace.plans.preflight import r6
from millrace.plans.registry import query
from millrace.session import table


@query("m1_triad", f"with {A.STEPS} select run, step, round(format_reward + accuracy_reward, 6) as composite from steps")
def m1_triad(spark: SparkSession, d: str) -> DataFrame:
    return r6(M.triad(A.steps(spark, d)).select("run", "step", "composite"))


def _means(c: str) -> str:
    return f"case when row_number() over w >= 10 then avg({c}) over (w rows between 4 preceding and current row) - avg({c}) over (w rows between 9 preceding and 5 preceding) end"


@query("m2_phase_changes", f"with {A.STEPS}, x as (select run, step, {_means('format_reward')} as f, {_means('accuracy_reward')} as a from steps window w as (partition by run order by step)) select run, step, round(f, 6) + 0.0 as format_delta, round(a, 6) + 0.0 as accuracy_delta, coalesce(f < -0.01 and a >= 0.003, false) as alert from x")
def m2_phase_changes(spark: SparkSession, d: str) -> DataFrame:
    """M2 with small thresholds, so that some alert."""
    return r6(M.phase_changes(A.steps(spark, d), "run", "step", drop=-0.01, gain=0.003).select("run", "step", "format_delta", "accuracy_delta", "alert"))


_PAIRS = r"""w as (select coalesce(source, '') as g, regexp_extract_all(lower(completion), '[\p{L}\p{N}_]+') as w from sft_examples where completion is not null), p as (select g, unnest(list_transform(range(1, len(w)), lambda i: {'a': w[i], 'b': w[i + 1]})) as p from w where len(w) >= 2)"""


@query("m3_diversity", f"with {_PAIRS} select g as \"group\", count(*) as total, count(distinct p) as distinct2, round(count(distinct p) / count(*), 6) as ratio, count(distinct p) / count(*) < 0.2 as collapsed from p group by g")
def m3_diversity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sft_examples").where("completion is not null").select(F.coalesce("source", F.lit("")).alias("g"), "completion")
    return r6(M.diversity(rows, "g", "completion").select("group", "total", "distinct2", "ratio", "collapsed"))


@query(
    "m4_governor",
    f"""with recursive {A.STEPS}, o as (select run, step, round(format_reward, 4) as x, row_number() over (partition by run order by step) as k from steps),
r as (select run, k, step, case when x < 0.2 then 1 else 0 end as low, 0 as remaining, false as active, 'nominal' as action from o where k = 1
  union all select o.run, o.k, o.step, case when o.x < 0.2 then r.low + 1 else 0 end, case when r.active then r.remaining - 1 when o.x < 0.2 and r.low >= 2 then 6 else r.remaining end,
    case when r.active then o.x < 0.21 and r.remaining - 1 > 0 else o.x < 0.2 and r.low >= 2 end, case when r.active and o.x < 0.21 and r.remaining - 1 > 0 then 'annealing' when r.active then 'recovered' when o.x < 0.2 and r.low >= 2 then 'started' else 'nominal' end from r join o on o.run = r.run and o.k = r.k + 1)
select run, step, active, case when active then 1.15::double else 0.7::double end as temperature, case when active then 0.05::double else 0.0::double end as bonus, low as low_steps, action from r""",
)
def m4_governor(spark: SparkSession, d: str) -> DataFrame:
    return M.governed(A.steps(spark, d).select("run", "step", F.round("format_reward", 4).alias("ratio")), "run", "step", "ratio", after=3, recovered=0.21, duration=6)


@query("m5_validation", f"""with recursive {A.STEPS}, e as (select run, step, validation_accuracy as acc from steps where step % 2 = 0 or step = 1), o as (select *, row_number() over (partition by run order by step) as k from e),
r as (select run, k, step, acc, acc > 0 + 0.005 as is_best, case when acc > 0.005 then acc else 0 end as best, case when acc > 0.005 then 0 else 2 end as stalled from o where k = 1
  union all select o.run, o.k, o.step, o.acc, o.acc > r.best + 0.005, case when o.acc > r.best + 0.005 then o.acc else r.best end, case when o.acc > r.best + 0.005 then 0 else r.stalled + 2 end from r join o on o.run = r.run and o.k = r.k + 1)
select run, step, round(acc, 6) as accuracy, is_best, not is_best and stalled >= 10 as stop from r""")
def m5_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = A.steps(spark, d).select("run", "step", F.col("validation_accuracy").alias("accuracy"))
    return r6(M.validated(rows, "run", "step", "accuracy", interval=2, patience=10))


_F1 = "case when validation_accuracy + format_reward <= 1e-8 then 0 else 2 * validation_accuracy * format_reward / (validation_accuracy + format_reward) end"


def _beats(c: str) -> str:
    return f"{c} > coalesce(greatest(max({c}) over (partition by run order by step rows between unbounded preceding and 1 preceding), 0), 0)"


@query("m6_pareto", f"with {A.STEPS}, f as (select *, {_F1} as f1 from steps) select run, step, round(f1, 6) as f1, {_beats('validation_accuracy')} as best_accuracy, {_beats('format_reward')} as best_format, {_beats('f1')} as balanced from f")
def m6_pareto(spark: SparkSession, d: str) -> DataFrame:
    return r6(M.pareto_classes(A.steps(spark, d), "run", "step", "validation_accuracy", "format_reward").select("run", "step", "f1", "best_accuracy", "best_format", "balanced"))


@query("m7_checkpoints", f"with {A.STEPS}, f as (select *, {_F1} as f1 from steps) select run, 'latest' as class, max(step) as step from f group by run union all select run, 'best_accuracy', arg_max(step, (validation_accuracy, -step)) from f group by run union all select run, 'best_format', arg_max(step, (format_reward, -step)) from f group by run union all select run, 'balanced_pareto', arg_max(step, (f1, -step)) from f group by run")
def m7_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return M.checkpoints(A.steps(spark, d), "run", "step", "validation_accuracy", "format_reward")


@query("m8_contention", """with s as (select i * 500.0::double as ms, t from range(1, 21) x(i), (values (true), (false)) y(t)), r as (select *, case when t then 800 * (6.0::double / (ms / 1000) + 3.0::double / 15) else 800 * 50 / (ms / 1000) end as rate from s)
select ms, t as tiered, round(rate, 6) as scrapes, round(18.5::double * least(1, rate / 80000), 6) as lock_pct, round(greatest(0, 1 - rate / 80000) * 100, 6) as reduction_pct, round(case when rate >= 40000 then 45 + 305 * ((rate - 40000) / 40000) when rate > 5000 then 45 + 35 * (rate / 40000) else 45 end, 6) as p99_ms, rate < 40000 as safe from r""")
def m8_contention(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.range(1, 21).select((F.col("id") * 500.0).alias("ms"), F.explode(F.array(F.lit(True), F.lit(False))).alias("tiered"))
    return r6(rows.select("ms", "tiered", M.scrape_contention(F.col("ms"), F.col("tiered")).alias("x")).select("ms", "tiered", "x.*"))


LINES = "lines as (select event_id, case when event_type = 'error' then 'kernel: NVRM: Xid (PCI:0000:' || lpad((user_id % 90 + 10)::varchar, 2, '0') || ':00): ' || (event_id % 100)::varchar || ', pid=' || user_id else 'kernel: usb 1-1: ' || event_type end as line from events)"


def kernel_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    fault = F.concat(F.lit("kernel: NVRM: Xid (PCI:0000:"), (F.col("user_id") % 90 + 10).cast("string"), F.lit(":00): "), (F.col("event_id") % 100).cast("string"), F.lit(", pid="), F.col("user_id").cast("string"))
    return e.select("event_id", F.when(F.col("event_type") == "error", fault).otherwise(F.concat(F.lit("kernel: usb 1-1: "), "event_type")).alias("line"))


_RE = M.LOG_LINE


@query("m9_faults", rf"with {LINES} select event_id, regexp_extract(line, '{_RE}', 1) as pci, regexp_extract(line, '{_RE}', 2)::int as code, trim(regexp_extract(line, '{_RE}', 3)) as reason, regexp_extract(line, '{_RE}', 2)::int in (31, 43, 45, 61, 62, 79, 92) as fatal, case when regexp_extract(line, '{_RE}', 2)::int in (31, 43, 45, 61, 62, 79, 92) then 'node.kubernetes.io/unschedulable:NoSchedule' else 'none' end as taint from lines where regexp_matches(line, '{_RE}')")
def m9_faults(spark: SparkSession, d: str) -> DataFrame:
    """M9, S15 and J4."""
    return M.log_faults(kernel_lines(spark, d), "line").select("event_id", "pci", "code", "reason", "fatal", "taint")


@query("m10_latest", "with s as (select user_id % 8 as gpu, (case event_type when 'view' then 'DCGM_FI_DEV_GPU_UTIL' when 'click' then 'DCGM_FI_DEV_GPU_TEMP' else 'other' end) as metric, ts, event_id, value from events) select gpu, metric, round(max_by(value, ts), 6) as value from s where metric <> 'other' group by all")
def m10_latest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    metric = F.when(F.col("event_type") == "view", "DCGM_FI_DEV_GPU_UTIL").when(F.col("event_type") == "click", "DCGM_FI_DEV_GPU_TEMP").otherwise("other")
    out = M.latest_metrics(e.select((F.col("user_id") % 8).alias("gpu"), metric.alias("metric"), "ts", "value"), "gpu")
    return r6(out.select("gpu", F.explode("metrics").alias("metric", "value")))


_SUS = "x as (select user_id % 50 as k, ts, value > 60 as o, sum(case when value > 60 then 0 else 1 end) over (partition by user_id % 50 order by ts) as island from events), s as (select k, island, min(ts) as began, max(ts) as last from x where o group by all)"


@query("m11_sustained", f"with {_SUS} select k, strftime(began, '%Y-%m-%d %H:%M:%S.%f') as began from s where epoch(last) - epoch(began) >= 300")
def m11_sustained(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("k"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return M.sustained(e, ["k"], "ts", "value", 60.0, 300.0).select("k", F.date_format("began", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("began"))


@query("m11_rates", "with g as (select user_id % 8 as k, ts, greatest(value - lag(value) over (partition by user_id % 8 order by ts), 0) as up from events) select k, (floor(epoch(ts) / 86400) * 86400)::bigint as start, round(coalesce(sum(up), 0) / 86400, 6) as rate from g group by all")
def m11_rates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 8).alias("k"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return r6(M.counter_rates(e, ["k"], "ts", "value", 86400).select("k", F.unix_seconds("start").alias("start"), "rate"))


_BUCKETS = "(values (10.0::double), (25.0), (50.0), (100.0), (250.0), (500.0), (1000.0), ('Infinity'::double))"


@query("m12_quantile", f"""with {A.REQUESTS}, b as (select mode, le, count_if(ttft_ms <= le) as c from requests, {_BUCKETS} t(le) where ttft_ms is not null group by all),
r as (select *, 0.95::double * max(c) over (partition by mode) as rank, coalesce(lag(c) over w, 0) as below, coalesce(lag(le) over w, 0) as lo from b window w as (partition by mode order by le)), h as (select *, row_number() over (partition by mode order by le) as k from r where c >= rank)
select mode, round(case when isinf(le) then lo else lo + (le - lo) * (rank - below) / (c - below) end, 6) as value from h where k = 1""")
def m12_quantile(spark: SparkSession, d: str) -> DataFrame:
    bounds = F.array(*[F.lit(float(x)) for x in (10, 25, 50, 100, 250, 500, 1000, "inf")])
    rows = A.requests(spark, d, "ttft_ms").where("ttft_ms is not null").select("mode", "ttft_ms")
    counts = rows.groupBy("mode").agg(*[F.count_if(F.col("ttft_ms") <= bounds[k]).alias(f"c{k}") for k in range(8)])
    long = counts.select("mode", F.explode(F.array(*[F.struct(bounds[k].alias("le"), F.col(f"c{k}").alias("count")) for k in range(8)])).alias("b")).select("mode", "b.*")
    return r6(M.histogram_quantile(long, ["mode"], 0.95))


@query(
    "m13_replicas",
    """with recursive p as (select (user_id % 4)::int as pool, floor(epoch(ts) / 3600) * 3600.0::double as t, count(*)::double as waiting from events group by all), o as (select *, least(3, greatest(1, ceil(waiting / 3)))::int as want, row_number() over (partition by pool order by t) as k from p),
r as (select pool, k, t, waiting, want as had, null::double as since from o where k = 1
  union all select o.pool, o.k, o.t, o.waiting, case when o.want >= r.had or o.t - coalesce(r.since, o.t) >= 7200 then o.want else r.had end, case when o.want >= r.had or o.t - coalesce(r.since, o.t) >= 7200 then null else coalesce(r.since, o.t) end from r join o on o.pool = r.pool and o.k = r.k + 1)
select pool, t as \"at\", waiting, had as replicas from r""",
)
def m13_replicas(spark: SparkSession, d: str) -> DataFrame:
    """Waiting requests by poll, from the events of each class."""
    e = table(spark, d, "events").select((F.col("user_id") % 4).cast("int").alias("pool"), (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600) * 3600.0).alias("at"))
    polls = e.groupBy("pool", "at").agg(F.count(F.lit(1)).cast("double").alias("waiting"))
    return M.scaled(polls, "pool", "at", "waiting", per_replica=3.0, cooldown_s=7200.0)
