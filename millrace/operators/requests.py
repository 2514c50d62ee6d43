"""Serving records: V1 to V23, J6, J7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.stats import exact_percentiles, joined_groups, sample_std
from millrace.session import cut

QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def classified(df: DataFrame) -> DataFrame:
    """V1: adds completed, truncated, shed, cancelled, unfinished, errored from stream_status and status_code. Nulls count as false; errored is what failed and is none of the others."""
    status, code = F.coalesce("stream_status", F.lit("")), F.coalesce("status_code", F.lit(0))
    success = (status == "COMPLETED") & (code == 200)
    df = df.withColumns({"completed": success, "truncated": status == "TRUNCATED", "shed": (status == "SHED") | (code == 429), "cancelled": status == "CANCELLED", "unfinished": status == "UNFINISHED"})
    return df.withColumn("errored", ~success & ~F.col("truncated") & ~F.col("shed") & ~F.col("cancelled") & ~F.col("unfinished"))


def counts() -> list[Column]:
    """V2: offered, admitted, failed and each class, over classified rows."""
    n = F.count(F.lit(1))
    own = [F.count_if(c).alias(c) for c in ("completed", "truncated", "shed", "cancelled", "unfinished", "errored")]
    failed = F.count_if("truncated") + F.count_if("errored") + F.count_if("cancelled") + F.count_if("unfinished")
    return [n.alias("offered"), (n - F.count_if("shed")).alias("admitted"), failed.alias("failed"), *own]


def with_quantiles(out: DataFrame, rows: DataFrame, keys: list[str], values: dict[str, Column], qs: dict[str, float] = QUANTILES, fixed: bool = False) -> DataFrame:
    """V3: a summary and the exact percentiles of some values of its groups' rows as name_p50 and so on, 0 where there is no value. Groups may be of any size."""
    found = exact_percentiles(rows, keys, values, tuple(qs.values()), fixed=fixed)
    cols = [F.coalesce(F.col(name)[k], F.lit(0.0)).alias(f"{name}_{p}") for name in values for k, p in enumerate(qs)]
    return joined_groups(out, found.select(*keys, *cols), keys)


def latencies() -> dict[str, Column]:
    """V4: first-token times of completed rows where positive, whole times of completed rows, waits of all rows where positive."""
    return {
        "ttft": F.when(F.col("completed") & (F.col("ttft_ms") > 0), F.col("ttft_ms")),
        "e2e": F.when(F.col("completed"), F.col("e2e_latency_ms")),
        "wait": F.when(F.col("queue_wait_ms") > 0, F.col("queue_wait_ms")),
    }


def rates(e2e_slo_ms: float = 2500.0, ttft_slo_ms: float = 250.0, window_s: float | None = None) -> list[Column]:
    """V5-V7: completed and tokens per second, attainment over offered rows, goodput. A target of 0 or less isn't asked for. The window is the given one, else the span of arrivals; without one rates are null."""
    window = F.lit(window_s) if window_s else F.nullif(F.max("arrival_time") - F.min("arrival_time"), F.lit(0.0))
    fast = F.col("completed")
    if e2e_slo_ms > 0:
        fast = fast & (F.col("e2e_latency_ms") <= e2e_slo_ms)
    within = F.count_if(fast)
    both = fast & (F.col("ttft_ms") <= ttft_slo_ms) if ttft_slo_ms > 0 else fast
    return [
        (F.count_if("completed") / window).alias("completed_per_s"), (F.sum(F.when(F.col("completed"), F.col("completion_tokens"))) / window).alias("tokens_per_s"),
        F.try_divide(within, F.count(F.lit(1))).alias("attainment"), (F.count_if(F.coalesce(both, F.lit(False))) / window).alias("goodput"),
    ]


def summary(df: DataFrame, keys: list[str], e2e_slo_ms: float = 2500.0, ttft_slo_ms: float = 250.0, window_s: float | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """V1-V7 for each key, V16 by mode, with exact percentiles of latencies() and of `more`: tpot, jitter and lag, say, where the rows have them."""
    rows = cut(classified(df))
    out = rows.groupBy(*keys).agg(*counts(), *rates(e2e_slo_ms, ttft_slo_ms, window_s))
    return with_quantiles(out, rows, keys, latencies() | (more or {}), fixed=True)


def token_times(events: DataFrame) -> DataFrame:
    """V8: request_id, ttft_s, tpot_s, jitter_ms, n_events from request_id, start_s, at_s, content (whether the event carries text).

    The first token is the first event with text, else the last event. Gaps are those between events with text; fewer than two give 0."""
    w = Window.partitionBy("request_id").orderBy("at_s")
    text = events.where("content").withColumn("gap", F.col("at_s") - F.lag("at_s").over(w))
    gaps = text.groupBy("request_id").agg(F.min("at_s").alias("first"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("tpot_s"), (F.coalesce(F.stddev_pop("gap"), F.lit(0.0)) * 1000).alias("jitter_ms"), F.count(F.lit(1)).alias("n_events"))
    whole = events.groupBy("request_id").agg(F.min("start_s").alias("start_s"), F.max("at_s").alias("last"))
    return whole.join(gaps, "request_id", "left").select("request_id", (F.coalesce("first", "last") - F.col("start_s")).alias("ttft_s"), F.coalesce("tpot_s", F.lit(0.0)).alias("tpot_s"), F.coalesce("jitter_ms", F.lit(0.0)).alias("jitter_ms"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


def gap_stats(df: DataFrame, gaps: str) -> DataFrame:
    """V8 where gaps come as an array: adds tpot_ms and jitter_ms; 0 for an empty or null array."""
    n, x = F.size(F.coalesce(gaps, F.array().cast("array<double>"))), F.col(gaps)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    spread = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n)
    return df.withColumns({"tpot_ms": F.when(n > 0, mean).otherwise(0.0), "jitter_ms": F.when(n > 0, spread).otherwise(0.0)})


def schedule_relative(df: DataFrame) -> DataFrame:
    """V9: adds lag_ms and latencies measured from the scheduled time. df: scheduled_s, dispatched_s, ttft_ms, e2e_latency_ms."""
    lag = F.greatest(F.lit(0.0), (F.col("dispatched_s") - F.col("scheduled_s")) * 1000)
    return df.withColumns({"lag_ms": lag, "ttft_scheduled_ms": F.col("ttft_ms") + lag, "e2e_scheduled_ms": F.col("e2e_latency_ms") + lag})


def terminal_status(events: DataFrame) -> DataFrame:
    """request_id, status, code from request_id, payload, disconnected: done, else cut off by the client, else truncated."""
    e = events.groupBy("request_id").agg(F.coalesce(F.bool_or(F.col("payload") == "[DONE]"), F.lit(False)).alias("done"), F.coalesce(F.bool_or("disconnected"), F.lit(False)).alias("gone"))
    return e.select("request_id", F.when(F.col("done"), "COMPLETED").when(F.col("gone"), "CANCELLED").otherwise("TRUNCATED").alias("status"), F.when(F.col("done"), 200).when(F.col("gone"), 499).otherwise(502).alias("code"))


def gateway_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """completed = admitted, answered and not hung up; percentiles of theirs, and tokens."""
    ok = F.col("admitted") & (F.col("status_code") == 200) & ~F.coalesce("client_disconnected", F.lit(False))
    values = {"ttft": F.when(ok & (F.col("ttft_ms") > 0), F.col("ttft_ms")), "e2e": F.when(ok, F.col("e2e_latency_ms"))}
    df = cut(df)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("completed"), F.count_if(~F.col("admitted")).alias("shed"), F.coalesce(F.sum(F.when(ok, F.col("completion_tokens"))), F.lit(0)).alias("tokens"))
    return with_quantiles(out, df, keys, values, {"p50": 0.5, "p90": 0.9, "p99": 0.99}, fixed=True)


def across_runs(runs: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Keys, measure, runs, mean and sample deviation (0 for one run) of per-run summaries."""
    long = runs.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])).alias("x")).select(*keys, "x.*")
    return long.groupBy(*keys, "measure").agg(F.count("v").alias("runs"), F.avg("v").alias("mean"), sample_std(F.col("v")).alias("std"))


def unbalanced(runs: DataFrame) -> DataFrame:
    """The summaries whose completed, shed and failed rows don't add up to the offered ones."""
    return runs.where(F.col("completed") + F.col("shed") + F.col("failed") != F.col("offered"))


def capacity(df: DataFrame, keys: list[str], order: str, rate: str, attainment: str, least: float = 0.95) -> DataFrame:
    """Capacity, the last rate of a sweep that reaches the attainment, by default its first; first_failure, the first that doesn't."""
    ok = F.col(attainment) >= least
    return df.groupBy(*keys).agg(F.coalesce(F.max_by(F.when(ok, F.col(rate)), F.when(ok, F.col(order))), F.min_by(rate, order)).alias("capacity"), F.min_by(F.when(~ok, F.col(rate)), F.when(~ok, F.col(order))).alias("first_failure"))


def phases(df: DataFrame, early_s: float, steady_s: float) -> Column:
    """Early, transition or steady by seconds since the start of the run (column since_s)."""
    return F.when(F.col("since_s") < early_s, "early").when(F.col("since_s") < steady_s, "transition").otherwise("steady")


def forwarding_delta(df: DataFrame, keys: list[str], mode: str, direct: str, forwarded: str, value: str) -> DataFrame:
    """Median of one mode less that of another."""
    of = lambda name: F.when(F.col(mode) == name, F.col(value))
    p = exact_percentiles(df, keys, {"direct": of(direct), "forwarded": of(forwarded)}, (0.5,)).select(*keys, F.col("direct")[0].alias("direct_p50"), F.col("forwarded")[0].alias("forwarded_p50"))
    return p.withColumn("delta", F.col("forwarded_p50") - F.col("direct_p50"))


def concurrency(rate: Column, seconds: Column) -> Column:
    """How many requests are under way on average, rounded up."""
    return F.ceil(rate * seconds)


def paired(runs: DataFrame, keys: list[str], mode: str, a: str, b: str, measures: list[str]) -> DataFrame:
    """Differences of two modes within each pair of runs."""
    x = runs.where(F.col(mode) == a).select(*keys, *[F.col(m).alias(f"a_{m}") for m in measures])
    y = runs.where(F.col(mode) == b).select(*keys, *[F.col(m).alias(f"b_{m}") for m in measures])
    return x.join(y, keys).select(*keys, *[(F.col(f"b_{m}") - F.col(f"a_{m}")).alias(m) for m in measures])


def with_gateway(client: DataFrame, gateway: DataFrame) -> DataFrame:
    """Client rows with the gateway's by request_id; rows without one keep nulls."""
    own = [c for c in gateway.columns if c != "request_id"]
    return client.join(gateway.select("request_id", *[F.col(c).alias(f"gateway_{c}") for c in own]), "request_id", "left")


def newest(df: DataFrame, order: str, n: int, keys: list[str] | None = None) -> DataFrame:
    """The n newest rows, of each key if there is one."""
    if not keys:
        return df.orderBy(F.desc(order)).limit(n)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")
