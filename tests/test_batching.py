import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.stats import ks_p_value
from millrace.operators import batching as B
from millrace.operators import memory as K
from tests.conftest import rows

LENGTHS = [120, 240, 800, 1500, 300, 950, 450, 1800, 210, 650]


def frame(spark, lengths):
    return spark.createDataFrame(list(enumerate(lengths)), "ordinal int, len int")


def test_golden_packing(spark):
    df = frame(spark, LENGTHS)
    m = B.packing_metrics(df, "len", 2).first()
    assert (m.useful, m.packed) == (7020, 7820) and abs(m.random - 10286.67) < 0.01
    assert abs(m.tokens_saved_pct - 24.0) < 0.1 and abs(m.density_gain_pct - 31.5) < 0.1
    b = B.length_sorted_batches(df, "len", "ordinal", 2).orderBy("batch_id", "place").collect()
    assert [[r.ordinal for r in b[k : k + 2]] for k in range(0, 10, 2)] == [[0, 8], [1, 4], [6, 9], [2, 5], [3, 7]]


@pytest.mark.parametrize("n,b", [(1, 4), (3, 4), (7, 3), (8, 4)])
def test_packing_against_brute_force(spark, n, b):
    rng = random.Random(n * 10 + b)
    lens = [rng.randint(1, 6) for _ in range(n)]
    m = B.packing_metrics(frame(spark, lens), "len", b).first()
    s = sorted(lens)
    assert m.packed == sum(max(s[k : k + b]) * len(s[k : k + b]) for k in range(0, n, b))
    costs = [sum(max(p[k : k + b]) * len(p[k : k + b]) for k in range(0, n, b)) for p in itertools.permutations(lens)] if n <= 8 else []
    assert math.isclose(m.random, sum(costs) / len(costs), rel_tol=1e-9)


@pytest.mark.parametrize("n,b,drop", [(7, 3, False), (7, 3, True), (8, 4, True), (3, 4, True)])
def test_shuffled_spread_against_brute_force(spark, n, b, drop):
    rng = random.Random(n * 10 + b)
    lens = [rng.randint(1, 6) for _ in range(n)]
    cost = lambda p: sum(max(p[k : k + b]) * len(p[k : k + b]) for k in range(0, n, b) if not drop or k + b <= n)
    costs = sorted(cost(p) for p in itertools.permutations(lens))
    mean = sum(costs) / len(costs)
    std = math.sqrt(sum((c - mean) ** 2 for c in costs) / len(costs))
    r = B.batch_size_sweep(frame(spark, lens), "len", (b,), 2000, drop_last=drop).first()
    assert math.isclose(r.random, mean, rel_tol=1e-9) and r.packed == cost(sorted(lens)) and r.shuffles == 2000
    assert abs(r.shuffled_mean - mean) <= 4 * std / math.sqrt(2000) and abs(r.shuffled_std - std) <= 0.1 * std
    assert (r.shuffled_min, r.shuffled_max) == (costs[0], costs[-1]) and r.shuffled_p05 <= mean <= r.shuffled_p95


def test_shuffles_in_blocks(spark):
    lens = [k * 37 % 90 + 1 for k in range(107)]
    df = frame(spark, lens)
    whole, parts = (B.shuffled_totals(df, "len", (2, 3, 8), 3000, block=k).groupBy("batch_size").agg(F.avg("total").alias("m"), F.stddev_pop("total").alias("s"), F.count("*").alias("n")).orderBy("batch_size").collect() for k in (1 << 20, 24))
    for x, y in zip(whole, parts):
        exact = B.expected_random_padding(df, "len", x.batch_size).first().random
        assert x.n == y.n == 3000 and abs(x.m - exact) < 4 * x.s / 54 and abs(y.m - exact) < 4 * y.s / 54 and abs(x.s / y.s - 1) < 0.1
    assert len(whole) == len(parts) == 3


def test_sweep_of_nothing(spark):
    r = B.batch_size_sweep(frame(spark, []), "len", (2, 4)).orderBy("batch_size").collect()
    assert [(x.batch_size, x.packed, x.shuffles, x.shuffled_mean) for x in r] == [(2, 0, 0, None), (4, 0, 0, None)]


def test_packing_of_nothing(spark):
    m = B.packing_metrics(frame(spark, []), "len", 4).first()
    assert (m.useful, m.packed, m.random, m.packed_waste) == (0, 0, 0.0, 0.0)


def test_collation(spark):
    mixed = frame(spark, [100] * 50 + [4000] * 50)
    m = B.max_distribution(mixed, "len", 32).first()
    assert m.worst == 4000 and m.worst_padded == 128000 and m.waste_pct > 25
    sure = B.max_distribution(frame(spark, [100, 200, 300, 4000]), "len", 4, 10_000).first()
    assert sure.p_over == 1.0 and sure.first_breach == 1
    s = B.simulated_padding(mixed, "len", 32, 200).agg(F.avg("longest"), F.count("*")).first()
    assert s[1] == 200 and abs(s[0] - m.mean_longest) < 60
    assert B.simulated_padding(frame(spark, []), "len", 4).count() == 0


def test_batch_translation(spark):
    df = spark.createDataFrame([(4, 2), (3, 2)], "b int, a int")
    assert [tuple(r[0]) for r in df.select(B.translated_batch(F.col("b"), F.col("a"))).collect()] == [(2, 4), (3, 2)]


def test_built_batches_are_whole(spark):
    df = frame(spark, [5] * 3 + [9] * 6)
    for grouped in (True, False):
        got = rows(B.built_batches(df, "len", "ordinal", 4, grouped).select("ordinal", "batch_id"), "ordinal")
        assert [k for k, _ in got] == list(range(9)) and sorted(b for _, b in got) == [0, 0, 0, 0, 1, 1, 1, 1, 2]


def test_signatures(spark, tmp_path):
    p = tmp_path / "x"
    p.write_bytes(b"a" * 100)
    one = B.file_signature(str(p), "t")
    assert one == B.file_signature(str(p), "t") != B.file_signature(str(p), "u")
    a = B.content_signature(frame(spark, LENGTHS), ["ordinal", "len"]).first()
    b = B.content_signature(frame(spark, LENGTHS).orderBy(F.desc("len")), ["ordinal", "len"]).first()
    assert a == b != B.content_signature(frame(spark, LENGTHS[:-1]), ["ordinal", "len"]).first()


def test_ks_of_equal_lengths():
    assert ks_p_value(1.0, 5, 5) < 0.05


def test_memory_golden(spark):
    df = spark.createDataFrame([(8, 1024, 1024)], "g int, p int, a int")
    x = K.prefix_sharing(F.col("g"), F.col("p"), F.col("a"), F.lit(28), F.lit(2), F.lit(128))
    r = df.select(*[c.alias(k) for k, c in x.items()]).first()
    assert (r.naive, r.shared, r.saved, r.saved_pct, r.prompt_saved_pct) == (16384, 9216, 7168, 43.75, 87.5)
    u = spark.createDataFrame([(24.0,)], "v double").select(K.usable_gb(F.col("v"), F.lit(True)), K.usable_gb(F.col("v"), F.lit(False))).first()
    assert abs(u[0] - 22.8) < 1e-9 and abs(u[1] - 20.4) < 1e-9


def test_memory_breakdown(spark):
    runs = K.models(spark).where("model like 'qwen%1.5b'").selectExpr("*", "1 as batch", "512 as seq", "'adamw' as optimizer", "'none' as strategy", "1 as world", "24.0D as vram_gb")
    r = K.breakdown(runs).first()
    assert abs(r.weights_gb - 1540000000 * 2 / 2**30) < 1e-6 and abs(r.optimizer_states_gb - 1540000000 * 12 / 2**30) < 1e-6 and r.communication_gb == 0
    moe = K.models(spark).where("experts is not null").selectExpr("*", "2 as batch", "8 as seq")
    assert moe.select(K.activation_bytes(moe)).first()[0] == int(32 * 16 * 4096 * (10 + 2 * 8 / 32 + 4.0 * math.ceil(16 * 2 / 8 * 1.25) / 16) * 2)


def test_storage_breaker(tmp_path):
    p = tmp_path / "x"
    p.write_text("x")
    slow = iter([0.0, 2.0, 0.0, 2.0])
    assert K.storage_penalty(str(p), False) == 1.0
    assert K.storage_penalty(str(p), True, clock=lambda: next(slow)) == 1.10
    with pytest.raises(K.StorageTooSlow):
        K.storage_penalty(str(p), False, clock=lambda: next(slow))
    with pytest.raises(FileNotFoundError):
        K.storage_penalty(str(tmp_path / "none"), True)


def test_memory_bill(spark):
    from millrace.operators import memory as K

    runs = K.models(spark).where("preference = 0").select("*", F.lit(2).alias("batch"), F.lit(2048).alias("seq"), F.lit("AdamW").alias("optimizer"), F.lit("none").alias("strategy"), F.lit(1).alias("world"), F.lit(24.0).alias("vram_gb"))
    df = K.breakdown(runs)
    parts = {r.part: r for r in K.bill(df, ["model"]).collect()}
    assert set(parts) == set(K.PARTS) and parts["optimizer_states"].large and not parts["weights"].large and abs(parts["weights"].pct_of_vram - parts["weights"].gb / 24 * 100) < 1e-9
    full = K.cause(df).first()
    assert full.cause == "optimizer_states" and abs(full.freed_gb - parts["optimizer_states"].gb * 2 / 3) < 1e-9
    small = K.breakdown(runs.withColumn("optimizer", F.lit("adamw8bit")).withColumn("batch", F.lit(64)), checkpointing=False)
    assert K.cause(small, False).first().cause == "activations" and K.cause(small, False, F.lit(50.0)).first().cause == "padding" and K.cause(small).first().cause == "balanced"
    assert [r[0] for r in spark.range(3).select(K.penalised(F.col("id") * 10 + 5, 1.10)).collect()] == [6, 16, 28]
