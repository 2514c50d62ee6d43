import heapq
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import admission, arrivals, policies
from millrace.operators import requests as V
from millrace.operators.sequential import folded
from tests.conftest import rows

REQ = "request_id string, mode string, arrival_time double, queue_wait_ms double, ttft_ms double, e2e_latency_ms double, status_code int, completion_tokens int, stream_status string"


def test_summary(spark):
    data = [
        ("a", "m", 0.0, 0.0, 100.0, 1000.0, 200, 10, "COMPLETED"), ("b", "m", 5.0, 4.0, 300.0, 2000.0, 200, 20, "COMPLETED"), ("c", "m", 10.0, 8.0, None, 0.0, 429, 0, "SHED"),
        ("d", "m", 2.0, None, 50.0, 9000.0, 200, 5, "TRUNCATED"), ("e", "m", 3.0, 0.0, None, 1.0, 500, 0, "ERROR"), ("f", "m", 4.0, 0.0, None, 1.0, 200, 0, "CANCELLED"), ("g", "n", 4.0, None, None, None, None, None, None),
    ]
    r = {x.mode: x for x in V.summary(spark.createDataFrame(data, REQ), ["mode"]).collect()}
    m = r["m"]
    assert (m.offered, m.admitted, m.failed, m.completed, m.shed, m.errored) == (6, 5, 3, 2, 1, 1)
    assert (m.ttft_p50, m.e2e_p50, m.wait_p50) == (200.0, 1500.0, 6.0)
    assert abs(m.completed_per_s - 0.2) < 1e-12 and abs(m.goodput - 0.1) < 1e-12 and abs(m.attainment - 2 / 6) < 1e-12 and m.tokens_per_s == 3.0
    assert r["n"].errored == 1 and r["n"].ttft_p99 == 0.0 and r["n"].goodput is None
    assert V.unbalanced(V.summary(spark.createDataFrame(data, REQ), ["mode"])).count() == 0
    assert V.summary(spark.createDataFrame([], REQ), ["mode"]).count() == 0


def test_across_runs(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("b", 12.0), ("b", 14.0)], "mode string, goodput double")
    assert rows(V.across_runs(df, ["mode"], ["goodput"]), "mode") == [("a", "goodput", 1, 10.0, 0.0), ("b", "goodput", 3, 12.0, 2.0)]


def test_capacity(spark):
    df = spark.createDataFrame([("m", k, r, a) for k, (r, a) in enumerate([(10.0, 1.0), (35.0, 0.99), (40.0, 0.9), (45.0, 0.96)])] + [("n", 0, 5.0, 0.1)], "mode string, ord int, rate double, att double")
    assert rows(V.capacity(df, ["mode"], "ord", "rate", "att"), "mode") == [("m", 45.0, 40.0), ("n", 5.0, 5.0)]


def test_token_times(spark):
    e = spark.createDataFrame([(1, 0.0, 0.5, False), (1, 0.0, 1.0, True), (1, 0.0, 1.2, True), (1, 0.0, 1.6, True), (2, 0.0, 3.0, False)], "request_id int, start_s double, at_s double, content boolean")
    got = rows(V.token_times(e), "request_id")
    assert got[0][:2] == (1, 1.0) and abs(got[0][2] - 0.3) < 1e-9 and abs(got[0][3] - 100) < 1e-6 and got[0][4] == 3
    assert got[1] == (2, 3.0, 0.0, 0.0, 0)


def test_newest(spark):
    df = spark.range(10).selectExpr("id", "id % 2 as k")
    assert rows(V.newest(df, "id", 2, ["k"]).select("id"), "id") == [(6,), (7,), (8,), (9,)]
    assert rows(V.newest(df, "id", 3).select("id"), "id") == [(7,), (8,), (9,)]


TRACE = "run string, request_id int, at_s double, service_s double"


def outcome(spark, data, **k):
    return {r.request_id: (r.outcome, round(r.wait_s, 6)) for r in admission.replayed(spark.createDataFrame(data, TRACE), "run", **k).collect()}


def test_admission_golden(spark):
    busy = [("r", 0, 0.0, 10.0), ("r", 1, 0.1, 1.0), ("r", 2, 0.2, 1.0), ("r", 3, 0.3, 1.0)]
    assert outcome(spark, busy, cap=1, queue=2, deadline_s=60) == {0: ("admitted", 0.0), 1: ("admitted", 9.9), 2: ("admitted", 10.8), 3: ("shed_capacity", 0.0)}
    assert outcome(spark, busy[:2], cap=1, queue=2, deadline_s=0.05) == {0: ("admitted", 0.0), 1: ("shed_deadline", 0.05)}
    assert outcome(spark, busy[:2], cap=1, queue=0) == {0: ("admitted", 0.0), 1: ("shed_capacity", 0.0)}
    assert outcome(spark, busy, mode="passthrough") == {k: ("admitted", 0.0) for k in range(4)}
    assert outcome(spark, busy, mode="static", cap=2)[2] == ("shed_capacity", 0.0)
    assert outcome(spark, [("r", 0, 0.0, 1.0), ("r", 1, 1.0, 1.0)], cap=1, queue=0) == {0: ("admitted", 0.0), 1: ("admitted", 0.0)}
    assert outcome(spark, [("r", 0, None, 1.0), ("r", 1, 0.0, None)], cap=1)[1] == ("admitted", 0.0)
    assert outcome(spark, []) == {}
    with pytest.raises(ValueError):
        admission.Gateway("other", 1, 1, 1)


def model(trace, cap, queue, deadline):
    """Plain event simulation: releases and deadlines by time, then arrivals."""
    out, running, waiting = {}, [], []

    def upto(now):
        while True:
            release = running[0] if running else None
            late = waiting[0][0] + deadline if waiting else None
            if late is not None and late < now and (release is None or late < release or len(running) < cap):
                t, k, s = waiting.pop(0)
                out[k] = ("shed_deadline", deadline)
            elif release is not None and release <= now:
                heapq.heappop(running)
                if waiting and waiting[0][0] + deadline >= release:
                    t, k, s = waiting.pop(0)
                    heapq.heappush(running, release + s)
                    out[k] = ("admitted", round(release - t, 6))
            else:
                return

    for k, at, s in trace:
        upto(at)
        if len(running) < cap:
            heapq.heappush(running, at + s)
            out[k] = ("admitted", 0.0)
        elif len(waiting) >= queue:
            out[k] = ("shed_capacity", 0.0)
        else:
            waiting.append((at, k, s))
    upto(float("inf"))
    return out


def test_admission_against_model(spark):
    rng = random.Random(4)
    data, want = [], {}
    for run in ("a", "b", "c"):
        t, trace = 0.0, []
        for k in range(300):
            t += rng.expovariate(8.0)
            trace.append((k, t, rng.expovariate(1.0)))
        data += [(run, ord(run) * 1000 + k, at, s) for k, at, s in trace]
        want |= {ord(run) * 1000 + k: v for k, v in model(trace, 5, 4, 0.3).items()}
    rng.shuffle(data)
    assert outcome(spark, data, cap=5, queue=4, deadline_s=0.3) == want


def test_folded_keeps_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).selectExpr("cast(id % 3 as int) as k", "id as t")
        got = folded(df, ["k"], ["t"], lambda: [0], lambda s, r: (s.__setitem__(0, s[0] + 1), [])[1], "k int, n int", lambda s: [(s[0],)])
        assert rows(got, "k") == [(0, 34), (1, 33), (2, 33)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_schedules(spark):
    assert arrivals.poisson_count(0, 1.0) == [] and arrivals.poisson_count(3, 0) == [0.0] * 3
    x = arrivals.poisson_count(10, 5.0)
    assert x[0] == 0.0 and x == sorted(x) and x == arrivals.poisson_count(10, 5.0)
    assert all(t < 20 for t in arrivals.poisson_window(20, 3.0)) and arrivals.poisson_window(20, 0) == []
    b = arrivals.burst(60, 1.0, 50.0)
    assert sum(20 <= t < 30 for t in b) > 5 * sum(t < 20 for t in b)
    g = arrivals.generated_trace(spark, 500, 10.0, ["a", "b"]).orderBy("request_id").collect()
    offsets = [r.arrival_offset_s for r in g]
    assert offsets == sorted(offsets) and len(g) == 500 and 30 < offsets[-1] < 75


def test_policies(spark):
    one = spark.range(1)

    def value(c):
        r = one.select(c.alias("x")).first()[0]
        return tuple(r) if hasattr(r, "asDict") else r

    assert value(policies.shed_by_delay(F.lit(500.0))) == (200, None) and value(policies.shed_by_delay(F.lit(501.0))) == (429, 15)
    assert value(policies.cascade(F.lit("Prove it"), F.lit(False))) == ("deep", False) and value(policies.cascade(F.lit("hi"), F.lit(True))) == ("fast", True)
    assert value(policies.cascade(F.lit("word " * 70), F.lit(True))) == ("fast", False) and value(policies.cascade(F.lit("word " * 70), F.lit(False))) == ("deep", False)
    assert value(policies.nearest_task(F.lit("Write CUDA kernel")))[:2] == ("code", "deep") and value(policies.nearest_task(F.lit("xyz"))) == ("conversational", "fast", 0.85)
    assert value(policies.leak_watch(F.lit(0), F.lit(420))) == (300, 15.0, 503) and value(policies.leak_watch(F.lit(1), F.lit(2000)))[2] == 200
    import hashlib

    for t in ("a", "tenant-7", ""):
        assert value(policies.pod_of(F.lit(t), 5)) == int(hashlib.md5(t.encode()).hexdigest(), 16) % 5


def test_quota(spark):
    df = spark.createDataFrame([("t", k) for k in range(20)] + [("u", 1)], "tenant string, block int")
    assert rows(policies.tenant_quota(df.withColumn("n", F.lit(1)), "tenant", "n", 100).select("tenant", "live"), "tenant") == [("t", 15), ("u", 1)]
    assert rows(policies.surviving_blocks(df.where("tenant = 't'"), "tenant", ["block"], 100).select("block"), "block") == [(k,) for k in range(5, 20)]


def test_flags_and_priming(spark):
    df = spark.createDataFrame([("m", 3, True, None), (None, 4, False, "x")], "model string, max_len int, fast boolean, extra string")
    got = [r[0] for r in df.select(policies.command_flags(df, ["model", "max_len", "fast", "extra"])).collect()]
    assert got == [["--model", "m", "--max-len", "3", "--fast"], ["--max-len", "4", "--extra", "x"]]
    assert policies.primed(df, "model", 4).columns[-3:] == ["pod", "tokens", "ms"] and policies.handoff(spark).count() == 5
