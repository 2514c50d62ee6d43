import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import admission
from millrace.sources import sse
from millrace.streaming import feeds
from tests.conftest import rows


def streamed(spark, df, name, build, files=3, mode="append"):
    """Rows of a stream over df's rows, in several files, until all is read."""
    import shutil
    import tempfile

    d = tempfile.mkdtemp()
    try:
        frame = df.toPandas().sort_values(df.columns[0], kind="stable")
        for k in range(files):  # one file after another, so that they come in this order
            part = frame.iloc[len(frame) * k // files : len(frame) * (k + 1) // files]
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
            time.sleep(0.05)
        s = build(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in"))
        q = s.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{d}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.table(name)
    finally:
        shutil.rmtree(d, ignore_errors=True)


def test_windows_equal_batch(spark):
    data = [(1.7e9 + k * 7 % 600, f"r{k}", "m", 200 if k % 5 else 429, "COMPLETED" if k % 5 else "SHED", float(k)) for k in range(250)]
    df = spark.createDataFrame(sorted(data), "arrival_time double, request_id string, mode string, status_code int, stream_status string, e2e_latency_ms double")
    build = lambda x: feeds.windowed_summary(x, ["mode"], "2 minutes", "1 hour").drop("p50", "p99")
    got = streamed(spark, df, "w", build, mode="complete")
    assert rows(got, "start") == rows(build(df), "start")


def test_fault_stream(spark):
    df = spark.createDataFrame([(k, f"NVRM: Xid (PCI:0000:01:00): {c}, x") for k, c in enumerate([31, 13, 79])], "k int, value string")
    assert rows(streamed(spark, df, "f", feeds.fault_alerts).select("code"), "code") == [(31,), (79,)]


def test_sse_stream_equals_batch(spark):
    text = "".join(f'data: {{"choices":[{{"delta":{{"content":"{k}"}}}}]}}\n\n' for k in range(30)) + "data: [DONE]\n\n"
    df = spark.createDataFrame([(s, r, text[s * 11 : s * 11 + 11], float(s)) for s in range(len(text) // 11 + 1) for r in (1, 2)], "seq long, request_id long, chunk string, at_s double")
    got = streamed(spark, df, "e", feeds.sse_events, 4)
    want = sse.events(df).select("request_id", "payload", "done", "content")
    assert sorted(rows(got.select("request_id", "payload", "done", "content"))) == sorted(rows(want))


def test_admission_stream_equals_batch(spark):
    df = spark.createDataFrame([(k * 0.1, "a" if k % 3 else "b", k, 0.35) for k in range(120)], "at_s double, run string, request_id int, service_s double")
    got = streamed(spark, df, "a", lambda x: feeds.admitted(x, "run", cap=2, queue=1, deadline_s=0.2), 3)
    want = admission.replayed(df, "run", cap=2, queue=1, deadline_s=0.2)
    done = {r[1]: r for r in rows(got)}
    assert len(done) >= 115 and all(done[r[1]] == r for r in rows(want) if r[1] in done)


def test_window_rates_equal_batch(spark):
    from millrace.operators.monitors import counter_rates

    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("s")).alias("ts")
    df = spark.createDataFrame([(30 * m, k, float(v)) for k, vs in (("k", [0, 10, 40, 5, 5, 25, 25, 90, 7]), ("j", [3, 3, 4])) for m, v in enumerate(vs)], "s int, k string, v double").select(at, "k", "v")
    own = lambda x: {(r.k, r.start): round(r.rate, 9) for r in x.collect()}
    assert own(feeds.window_rates(df, ["k"], "ts", "v", 120)) == own(counter_rates(df, ["k"], "ts", "v", 120))
    assert feeds.window_rates(df, ["k"], "ts", "v", 120, limit=0.3).count() == 2


def test_buffer_of_bad_payload():
    b = sse.EventBuffer()
    assert b.feed("data: {bad\n\nda") == [(0, "{bad")] and b.feed("ta: [DONE]\n") == [] and b.feed("\ndata: x\n\n") == [(1, "[DONE]"), (2, "x")] and not b.tail
