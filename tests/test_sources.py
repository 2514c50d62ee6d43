import json
import math

from pyspark.sql import functions as F

from millrace.sources import jsonl, sse, telemetry
from tests.conftest import rows


def test_lines_and_repair(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"prompt": "a", "completion": "b"}\n\n   \n{\'prompt\': \'c\'},\n{bad\nnull\n[1]\n{"question": "d", "labels": [1, -100]}\n')
    df, bad = jsonl.sft_rows(spark, str(p))
    assert bad == 3 and sorted((r.prompt or r.question) for r in df.collect()) == ["a", "c", "d"]
    strict, bad = jsonl.pair_rows(spark, str(p))
    assert bad == 4 and strict.count() == 2


def test_sides(spark):
    lines = [json.dumps({"prompt": "p", "chosen": [{"role": "assistant", "content": "a"}], "rejected": "[not a list"})]
    df = jsonl.parsed(spark.createDataFrame([(x,) for x in lines], "value string"), schema=jsonl.PAIR, repair=False).select("row.*")
    r = jsonl.sides_of_json(df).first()
    assert r.chosen[0].content == "a" and r.rejected[0].content == "[not a list"


def test_prompts_and_split(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, [("user", "m")], "y"), (3, [], None)], "k int, messages array<struct<role:string,content:string>>, prompt string")
    assert rows(jsonl.prompts(df, 5, "k")) == [("x",), ("m",)]
    m = spark.createDataFrame([(0, "q0", "a #### 1"), (1, "q1", "b #### 2 "), (2, None, None)], "i int, question string, answer string")
    assert rows(jsonl.math_split(m, "i", 1, 1).select("i", "target")) == [(1, "2")]


def test_trace_round_trip(spark, tmp_path):
    df = spark.read.schema(jsonl.TRACE).json(spark.sparkContext.parallelize(['{"request_id": "r", "prompt_tokens": 3, "messages": [{"role": "user", "content": "x"}], "arrival_offset_s": 0.5}']))
    jsonl.write_trace(df, str(tmp_path / "t"))
    assert rows(jsonl.read_trace(spark, str(tmp_path / "t"))) == rows(df)


def test_sse_over_chunks(spark):
    text = 'data: {"choices":[{"delta":{"role":"assistant"}}]}\r\n\r\ndata: {"choices":[{"delta":{"content":"hi"}}]}\n\n: comment\n\ndata: a\ndata: b\n\ndata: [DONE]\n\ndata: rest'
    for size in (1, 7, 1000):
        parts = [text[k : k + size] for k in range(0, len(text), size)]
        df = spark.createDataFrame([(1, k, p, float(k)) for k, p in enumerate(parts)] + [(None, 0, "x", 0.0), (2, 0, None, 0.0)], "request_id int, seq int, chunk string, at_s double")
        got = sse.events(df).orderBy("event").collect()
        assert [(r.done, r.content) for r in got] == [(False, False), (False, True), (False, False), (True, False)] and got[2].payload == "a\nb"
        assert got[0].at_s <= got[1].at_s <= got[3].at_s


def test_metrics(spark):
    lines = ["# TYPE a gauge", "a 1", 'b{le="0.5",x="y z"} 2.5e3', "c +Inf", "d NaN", "bad line", ""]
    got = {r.metric: r for r in telemetry.metrics(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["b"].labels == {"le": "0.5", "x": "y z"} and got["b"].number == 2500.0 and got["c"].number == math.inf and math.isnan(got["d"].number)


def test_device_samples(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("t0, P0, 60, 250.5 W, 90 %, 40 %, 1000 MiB, 1500, 7000\nshort, line\nt1, P2, [Not Supported], 1, 2, 3, 4, 5, 6\n")
    got = rows(telemetry.device_samples(spark, str(p)), "ts")
    assert got[0] == ("t0", "P0", 60.0, 250.5, 90.0, 40.0, 1000.0, 1500.0, 7000.0) and got[1][2] is None and len(got) == 2


def test_config_and_reports(spark, tmp_path):
    y, j = tmp_path / "c.yaml", tmp_path / "c.json"
    y.write_text("model: 'a/b'  # name\nmax_len: 2048\nratio: 0.9\nflag: True\n")
    j.write_text('{"stage": 3}')
    assert telemetry.config(spark, str(y)).first().asDict() == {"model": "a/b", "max_len": 2048, "ratio": 0.9, "flag": True}
    assert telemetry.config(spark, str(j)).first().stage == 3
    df = spark.createDataFrame([("m", 1.234, 0.5)], "mode string, a double, b double")
    assert telemetry.markdown_rows(df, "mode", [("a", "b")]).first().line == "| m | 1.23 ± 0.50 |"
    telemetry.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["mode"] == "m"


def test_missing_parquet_is_an_error(spark, tmp_path):
    import pytest

    with pytest.raises(Exception):
        jsonl.parquet_rows(spark, str(tmp_path / "none")).count()


def test_head(spark):
    assert rows(jsonl.head(spark.range(10).withColumn("x", F.col("id")), "id", 2, ["id"])) == [(0,), (1,)]
