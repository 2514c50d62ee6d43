"""Streams of requests, logs and server-sent events. Watermarks and windows are extensions; each stream gives the rows of its batch form once all input is there."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.frames import plain
from millrace.operators.admission import Gateway
from millrace.operators.monitors import log_faults
from millrace.operators.requests import classified
from millrace.sources.sse import EventBuffer


def event_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def windowed_summary(requests: DataFrame, keys: list[str], window: str = "1 minute", lateness: str = "10 minutes", e2e_slo_ms: float = 2500.0) -> DataFrame:
    """keys, start, offered, completed, shed, within, p50, p99: V1-V6 by event-time window. Rows later than the watermark are dropped by it; percentiles are approximate, their state being bounded.

    Deliveries of a request beyond the first are dropped within the watermark."""
    rows = classified(requests).withColumn("at", event_time(F.col("arrival_time"))).withWatermark("at", lateness)
    if requests.isStreaming:
        rows = rows.dropDuplicatesWithinWatermark(["request_id"])
    else:
        rows = rows.dropDuplicates(["request_id"])
    ok = F.when(F.col("completed"), F.col("e2e_latency_ms"))
    out = rows.groupBy(F.window("at", window), *keys).agg(
        F.count(F.lit(1)).alias("offered"), F.count_if("completed").alias("completed"), F.count_if("shed").alias("shed"), F.count_if(F.col("completed") & (F.col("e2e_latency_ms") <= e2e_slo_ms)).alias("within"),
        F.percentile_approx(ok, 0.5, 1000).alias("p50"), F.percentile_approx(ok, 0.99, 1000).alias("p99"),
    )
    return out.select(*keys, F.col("window.start").alias("start"), "offered", "completed", "shed", "within", "p50", "p99")


def fault_alerts(lines: DataFrame, line: str = "value") -> DataFrame:
    """M9: fatal device faults of a log stream, without state."""
    return log_faults(lines, line).where("fatal")


def window_rates(samples: DataFrame, keys: list[str], ts: str, value: str, window_s: int = 300, lateness: str = "10 minutes", limit: float | None = None) -> DataFrame:
    """Keys, start, rate of a counter by tumbling window; with a limit only windows above it. Falls count as restarts and add nothing.

    A sample goes to its own window and, as the value before, to the next one, so the step between two windows counts as in the batch form; a step over a whole empty window does not. A window's samples of a key are held until it closes."""
    at = F.unix_micros(ts) / 1e6
    own = F.floor(at / window_s)
    each = samples.withWatermark(ts, lateness).where(F.col(value).isNotNull()).select(*keys, ts, F.named_struct(F.lit("t"), at, F.lit("v"), F.col(value).cast("double"), F.lit("w"), own).alias("s"), F.explode(F.array(F.lit(0), F.lit(1))).alias("next"))
    # the next window's stand-in time lies within it, so that its watermark closes it
    shifted = each.withColumn("at", F.col(ts) + F.make_dt_interval(secs=F.col("next") * window_s))
    grouped = shifted.groupBy(F.window("at", f"{window_s} seconds"), *keys).agg(F.array_sort(F.collect_list("s")).alias("s"))
    start = F.unix_seconds("window.start")
    steps = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.when(F.get("s", i)["w"] * window_s == start, F.greatest(F.lit(0.0), F.get("s", i)["v"] - F.get("s", i - 1)["v"])).otherwise(0.0))
    up = F.when(F.size("s") > 1, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
    out = grouped.where(F.exists("s", lambda x: x["w"] * window_s == start)).select(*keys, F.col("window.start").alias("start"), (up / window_s).alias("rate"))
    return out if limit is None else out.where(F.col("rate") > limit)


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout


def _has_content(payload: str) -> bool:
    try:
        return bool(json.loads(payload)["choices"][0]["delta"]["content"])
    except (ValueError, KeyError, IndexError, TypeError):
        return False


def sse_events(chunks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """request_id, event, payload, done, content of a stream of request_id, seq, chunk. A key's state is its unfinished event; it is removed once the stream says that it is done, or, where idle_ms is given, after so long without a chunk."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["request_id", "event", "payload", "done", "content"]
        if state.hasTimedOut:
            state.remove()
            yield plain(pd.DataFrame([], columns=names))
            return
        buffer = pickle.loads(state.get[0]) if state.exists else EventBuffer()
        out, over = [], False
        rows = pd.concat(list(frames), ignore_index=True).sort_values("seq", kind="stable")
        for chunk in rows["chunk"]:
            for event, payload in buffer.feed(chunk or ""):
                over = payload.strip() == "[DONE]"
                out.append((key[0], event, payload, over, _has_content(payload)))
        if over and not buffer.tail:
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps(buffer),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield plain(pd.DataFrame(out, columns=names))

    return chunks.groupBy("request_id").applyInPandasWithState(run, "request_id long, event long, payload string, done boolean, content boolean", "buffer binary", "append", _timeout(idle_ms))


def admitted(trace: DataFrame, key: str, mode: str = "bounded_queue", cap: int = 36, queue: int = 36, deadline_s: float = 0.25, idle_ms: int | None = None) -> DataFrame:
    """A1 on a stream of key, request_id, at_s, service_s, in order of time from batch to batch. What still waits when the stream ends has no row; the state of a key is what runs and what waits, and goes, where idle_ms is given, after so long without a request."""
    kind = dict(trace.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield plain(pd.DataFrame([], columns=[key, "request_id", "outcome", "wait_s"]))
            return
        gateway = pickle.loads(state.get[0]) if state.exists else Gateway(mode, cap, queue, deadline_s)
        out = []
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["at_s", "request_id"], kind="stable")
        for r in rows.itertuples():
            out += [(k[0], *x) for x in gateway.offer(r.at_s, max(0.0, r.service_s), (r.request_id,))]
        state.update((pickle.dumps(gateway),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield plain(pd.DataFrame(out, columns=[key, "request_id", "outcome", "wait_s"]))

    return trace.where("at_s is not null").groupBy(key).applyInPandasWithState(run, f"{key} {kind[key]}, request_id {kind['request_id']}, outcome string, wait_s double", "gateway binary", "append", _timeout(idle_ms))
