"""Queries B1-B13 and K1-K13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import batching as B
from millrace.operators import memory as K
from millrace.plans import adapters as A
from millrace.plans.preflight import r6
from millrace.plans.registry import query

_L = A.LENGTHS


@query("b_sorted_batches", f"with {_L}, r as (select ordinal, len, row_number() over (order by len, ordinal) - 1 as k from lengths) select ordinal, len, (k // 4)::bigint as batch_id, (k % 4)::int as place from r")
def b_sorted_batches(spark: SparkSession, d: str) -> DataFrame:
    """B2."""
    return B.length_sorted_batches(A.lengths(spark, d), "len", "ordinal", 4)


@query("b_packed_padding", f"with {_L}, r as (select len, row_number() over (order by len, ordinal) - 1 as k from lengths), b as (select max(len) * count(*) as p, sum(len) as u from r group by k // 4) select sum(u)::bigint as useful, sum(p)::bigint as packed from b")
def b_packed_padding(spark: SparkSession, d: str) -> DataFrame:
    """B1 and B3."""
    return B.packed_padding(A.lengths(spark, d), "len", 4)


_RANDOM = f"""with {_L}, r as (select len::double as len, row_number() over (order by len) as i, count(*) over () as n from lengths),
b as (select min(n) as n, sum(len) as u, sum(case when i >= 4 then len * ((i - 1) * (i - 2) * (i - 3) / 6.0::double) / (n::double * (n - 1) * (n - 2) * (n - 3) / 24.0::double) end) as m4,
  sum(case when i >= 3 then len * ((i - 1) * (i - 2) / 2.0::double) / (n::double * (n - 1) * (n - 2) / 6.0::double) end) as m3, sum(case when i >= 2 then len * (i - 1)::double / (n::double * (n - 1) / 2.0::double) end) as m2, avg(len) as m1 from r)"""


@query("b_random_padding", _RANDOM + " select round(4 * m4 * (n // 4) + case n % 4 when 3 then 3 * m3 when 2 then 2 * m2 when 1 then m1 else 0 end, 4) as random from b")
def b_random_padding(spark: SparkSession, d: str) -> DataFrame:
    """B4."""
    return B.expected_random_padding(A.lengths(spark, d), "len", 4).select(F.round("random", 4).alias("random"))


_SHARE = "coalesce(greatest(({0} - useful) / {0} * 100, 0), 0)"


@query(
    "b_packing_metrics",
    f"""{_RANDOM}, e as (select 4 * m4 * (n // 4) + case n % 4 when 3 then 3 * m3 when 2 then 2 * m2 when 1 then m1 else 0 end as random from b),
k as (select sum(m * c)::double as packed, sum(u)::double as useful from (select max(len) as m, count(*) as c, sum(len) as u from (select len, row_number() over (order by len, ordinal) - 1 as k from lengths) group by k // 4)),
w as (select *, {_SHARE.format('packed')} as packed_waste, {_SHARE.format('random')} as random_waste from k, e)
select useful::bigint as useful, packed::bigint as packed, round(random, 4) as random, round(packed_waste, 4) as packed_waste, round(random_waste, 4) as random_waste, round(greatest(random_waste - packed_waste, 0), 4) as waste_reduction, round(greatest((random - packed) / random * 100, 0), 4) as tokens_saved_pct,
  round(greatest((random / packed - 1) * 100, 0), 4) as density_gain_pct, 'exact_expectation' as baseline from w""",
)
def b_packing_metrics(spark: SparkSession, d: str) -> DataFrame:
    """B5."""
    out = B.packing_metrics(A.lengths(spark, d), "len", 4)
    return out.withColumns({c: F.round(c, 4) + 0.0 for c, t in out.dtypes if t == "double"})


@query("b_translated", "select b::int as batch, a::int as accumulation, (case when b % 2 = 0 then b // 2 else b end)::int as new_batch, (case when b % 2 = 0 then a * 2 else a end)::int as new_accumulation from range(1, 17) t(b), range(1, 3) s(a)")
def b_translated(spark: SparkSession, d: str) -> DataFrame:
    """B6."""
    rows = spark.range(1, 17).select(F.col("id").cast("int").alias("batch"), F.explode(F.array(F.lit(1), F.lit(2))).alias("accumulation"))
    return rows.withColumn("t", B.translated_batch(F.col("batch"), F.col("accumulation"))).select("batch", "accumulation", F.col("t.batch").alias("new_batch"), F.col("t.accumulation").alias("new_accumulation"))


@query("b_collation_exact", f"""with {_L}, r as (select len::double as len, row_number() over (order by len) as i, count(*) over () as n from lengths),
w as (select *, ((i - 1)::double * (i - 2) * (i - 3) / 6) / (n::double * (n - 1) * (n - 2) * (n - 3) / 24) as p from r)
select round(sum(len * p), 6) as mean_longest, max(len)::bigint as worst, round(avg(len) * 4, 6) as mean_useful, round(sum(case when len * 4 > 8000 then p else 0 end), 6) as p_over, round(sum(len * p) * 4, 6) as mean_padded, max(len)::bigint * 4 as worst_padded,
  round((sum(len * p) * 4 - avg(len) * 4) / (sum(len * p) * 4) * 100, 6) as waste_pct from w""")
def b_collation_exact(spark: SparkSession, d: str) -> DataFrame:
    """B7 without sampling."""
    return r6(B.max_distribution(A.lengths(spark, d), "len", 4, 8000).drop("first_breach"))


@query("b_collation_simulated")
def b_collation_simulated(spark: SparkSession, d: str) -> DataFrame:
    """B7 by simulation."""
    s = B.simulated_padding(A.lengths(spark, d), "len", 4)
    return s.agg(F.count(F.lit(1)).alias("trials"), F.avg("padded").alias("mean_padded"), F.max("padded").alias("worst_padded"), F.percentile("padded", F.lit(0.95)).alias("p95"), F.percentile("padded", F.lit(0.99)).alias("p99"), F.percentile("padded", F.lit(0.999)).alias("p999"))


@query("b_sweep")
def b_sweep(spark: SparkSession, d: str) -> DataFrame:
    """B8."""
    return r6(B.batch_size_sweep(A.lengths(spark, d), "len"))


@query("b_built_batches")
def b_built_batches(spark: SparkSession, d: str) -> DataFrame:
    """Padding of both kinds of batches."""
    rows = A.lengths(spark, d)
    out = None
    for grouped in (False, True):
        b = B.built_batches(rows, "len", "ordinal", 4, grouped).join(rows, "ordinal").groupBy("batch_id").agg(F.max("len").alias("m"), F.count(F.lit(1)).alias("n"))
        one = b.agg(F.lit(grouped).alias("grouped"), F.count(F.lit(1)).alias("batches"), F.sum(F.col("m") * F.col("n")).alias("padded"))
        out = one if out is None else out.unionByName(one)
    return out


@query("b_content_signature")
def b_content_signature(spark: SparkSession, d: str) -> DataFrame:
    """B10 of a table."""
    return B.content_signature(A.lengths(spark, d), ["ordinal", "len"])


@query("b_signature", f"with {_L} select count(*) as n, sum(len)::bigint as total, round(avg(len), 6) as mean, round(stddev_pop(len), 6) as std, min(len) as shortest, max(len) as longest, round(quantile_cont(len, 0.5), 6) as p50, round(quantile_cont(len, 0.9), 6) as p90, round(quantile_cont(len, 0.95), 6) as p95, round(quantile_cont(len, 0.99), 6) as p99, round(quantile_cont(len, 0.999), 6) as p999 from lengths")
def b_signature(spark: SparkSession, d: str) -> DataFrame:
    """B11."""
    return r6(B.dataset_signature(A.lengths(spark, d), "len"))


@query("b_stride_sample", f"with {_L}, r as (select ordinal, len, row_number() over (order by ordinal) - 1 as k, count(*) over () as n from lengths) select ordinal, len from r where k % greatest(1, n // 300) = 0 and k < greatest(1, n // 300) * 300")
def b_stride_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample."""
    from millrace.operators.sft import dense_ordinal

    rows = A.lengths(spark, d)
    return B.stride_sample(dense_ordinal(rows, "ordinal", "k"), "k", rows.count(), 300).select("ordinal", "len")


_STEPS = "t as (select event_id as step, (event_id % 97 + 10)::bigint as useful, (event_id % 97 + 10 + event_id % 13)::bigint as padded, 0.25::double as seconds, value as loss from events)"


def train_steps(spark: SparkSession, d: str) -> DataFrame:
    from millrace.session import table

    k = F.col("event_id")
    return table(spark, d, "events").select(k.alias("step"), (k % 97 + 10).alias("useful"), (k % 97 + 10 + k % 13).alias("padded"), F.lit(0.25).alias("seconds"), F.col("value").alias("loss"))


@query("b_throughput", f"with {_STEPS} select round(sum(useful) / sum(seconds), 6) as overall, round(sum(useful) filter (where step >= 5) / sum(seconds) filter (where step >= 5), 6) as steady, round((sum(padded) - sum(useful)) / sum(padded) * 100, 6) as waste_pct, round(avg(loss), 6) as mean_loss, round(min_by(loss, step), 6) as first_loss, round(max_by(loss, step), 6) as last_loss from t")
def b_throughput(spark: SparkSession, d: str) -> DataFrame:
    """B12."""
    return r6(B.throughput(train_steps(spark, d)))


_ARMS = """select regime || '-' || seed as pair, mode as arm, avg(e2e_latency_ms) as e2e, avg(queue_wait_ms) as wait from requests group by all"""


@query("b_paired_deltas", f"with {A.REQUESTS}, a as ({_ARMS}), p as (select pair, (x.e2e - y.e2e) / x.e2e as e2e, (x.wait - y.wait) / nullif(x.wait, 0) as wait from (select * from a where arm = 'direct') x join (select * from a where arm = 'bounded_queue') y using (pair)), l as (select 'e2e' as measure, e2e as d from p union all select 'wait', wait from p) select measure, count(d) as pairs, round(avg(d), 6) as mean, round(case when count(d) = 1 then 0 else stddev_samp(d) end, 6) as std from l group by 1")
def b_paired_deltas(spark: SparkSession, d: str) -> DataFrame:
    """B13."""
    arms = A.requests(spark, d, "e2e_latency_ms", "queue_wait_ms").groupBy(F.concat_ws("-", "regime", "seed").alias("pair"), F.col("mode").alias("arm")).agg(F.avg("e2e_latency_ms").alias("e2e"), F.avg("queue_wait_ms").alias("wait"))
    return r6(B.paired_deltas(arms, "pair", "arm", ["e2e", "wait"], "direct", "bounded_queue"))


@query("k_models", "select * from (values ('Qwen/Qwen2.5-1.5B-Instruct', 'qwen/qwen2.5-1.5b', 1540000000::bigint), ('llama-3-8b', 'meta-llama/llama-3-8b', 8030000000), ('MISTRALAI/Mixtral-8x7B-v0.1', 'mistralai/mixtral-8x7b', 46700000000), ('other', null, null)) t(name, model, params)")
def k_models(spark: SparkSession, d: str) -> DataFrame:
    """K1."""
    names = spark.createDataFrame([("Qwen/Qwen2.5-1.5B-Instruct",), ("llama-3-8b",), ("MISTRALAI/Mixtral-8x7B-v0.1",), ("other",)], "name string")
    return K.resolved_models(names, spark).select("name", "model", "params")


@query("k_devices", "select * from (values ('A100-80GB', 80.0::double), ('h100-80gb', 80.0::double), ('rtx 12gb', 12.0::double), ('unknown', 24.0::double)) t(name, gb)")
def k_devices(spark: SparkSession, d: str) -> DataFrame:
    """K2."""
    return spark.createDataFrame([("A100-80GB",), ("h100-80gb",), ("rtx 12gb",), ("unknown",)], "name string").select("name", K.device_gb(F.col("name")).alias("gb"))


def memory_runs(spark: SparkSession) -> DataFrame:
    shapes = spark.createDataFrame([(b, s, o, t, w) for b in (1, 8) for s in (512, 4096) for o in ("adamw", "adamw8bit") for t, w in (("none", 1), ("ddp", 4), ("zero3", 8), ("tensor_parallel", 2))], "batch int, seq int, optimizer string, strategy string, world int")
    return shapes.join(F.broadcast(K.models(spark))).withColumn("vram_gb", F.lit(80.0))


_MODELS = ", ".join(f"({', '.join('null' if x is None else repr(x) for x in m)})" for m in K.MODELS)
_ORDER = ("optimizer_states", "activations", "weights", "gradients", "communication")


@query(
    "k_breakdown",
    f"""with m(model, layers, hidden, heads, kv_heads, vocab, params, experts, experts_used) as (values {_MODELS}), s as (select * from (values (1), (8)) a(batch), (values (512), (4096)) b(seq), (values ('adamw'), ('adamw8bit')) c(optimizer), (values ('none', 1), ('ddp', 4), ('zero3', 8), ('tensor_parallel', 2)) e(strategy, world)),
x as (select *, 80.0::double as vram_gb, (batch * seq)::double as t, case when strategy = 'zero3' and world > 1 then world else 1 end as shared from m, s),
f as (select *, 10 + 2 * kv_heads::double / heads + case when experts is not null then least(t * experts_used, ceil(t * experts_used / experts * 1.25::double)) / t * 4 else 0 end as factor from x),
g as (select *, floor(params * 2.0::double / shared) / 1073741824 as weights_gb, floor(params * 2.0::double / shared) / 1073741824 as gradients_gb, floor(params * (case when optimizer = 'adamw8bit' then 4.0::double else 12.0::double end) / shared) / 1073741824 as optimizer_states_gb, floor(layers * t * hidden * factor * 2) / 1073741824 as activations_gb,
  case when world <= 1 then 0 else 2 * 4194304 * 8 * least(2, world - 1) + case strategy when 'zero3' then 1000000000 when 'tensor_parallel' then 2 * t * hidden * 2 when 'ddp' then 26214400 else 0 end end::double / 1073741824 as communication_gb from f),
h as (select *, weights_gb + gradients_gb + optimizer_states_gb + activations_gb + communication_gb as total_gb from g), i as (select *, vram_gb - total_gb as headroom_gb, total_gb / vram_gb * 100 as utilisation, 0.5 * least(100, total_gb / vram_gb * 100) + 0.5 * 80 as score, greatest({', '.join(f'{n}_gb' for n in _ORDER)}) as most from h)
select batch, seq, optimizer, strategy, world, model, layers, hidden, heads, kv_heads, vocab, params, experts, experts_used, vram_gb, case when optimizer_states_gb > total_gb * 0.45::double and optimizer <> 'adamw8bit' then 'optimizer_states' else 'balanced' end as cause, round(case when optimizer_states_gb > total_gb * 0.45::double and optimizer <> 'adamw8bit' then optimizer_states_gb * 8 / 12 end, 6) as freed_gb, {', '.join(f'round({n}_gb, 6) as {n}_gb' for n in _ORDER)}, round(total_gb, 6) as total_gb, round(headroom_gb, 6) as headroom_gb, total_gb <= vram_gb as fits, round(utilisation, 6) as utilisation, 68.0::double as usable,
  case most {' '.join(f"when {n}_gb then '{n}'" for n in _ORDER)} end as largest, round(score, 6) as score, case when least(100, utilisation) < 60 and headroom_gb >= 6 then greatest(batch + 4, floor(batch * 85.0::double / greatest(least(100, utilisation), 10)))::bigint end as larger_batch, round((1 - 0.99::double ** 100) * 100, 6) as risk,
  case when score >= 80 then 'A' when score >= 65 then 'B' when score >= 50 then 'C' else 'D' end as grade from i""",
)
def k_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """K3-K8 over all architectures and some shapes."""
    df = K.cause(K.breakdown(memory_runs(spark)))
    df = df.withColumns({"usable": K.usable_gb(F.col("vram_gb"), F.lit(False)), "largest": K.largest_part(df), "score": K.efficiency(F.col("utilisation"), F.lit(None).cast("double")), "larger_batch": K.upscaled_batch(F.col("batch"), F.col("utilisation"), F.col("headroom_gb")), "risk": K.cumulative_risk(F.lit(0.01), F.lit(100))})
    return r6(df.withColumn("grade", K.grade(F.col("score"))).drop("preference"))


@query("k_bill", "with m(model, params) as (values " + ", ".join(f"('{m[0]}', {m[6]})" for m in K.MODELS) + "), p as (select model, x.part, floor(params * x.b) / 1073741824 as gb from m, (values ('weights', 2.0::double), ('gradients', 2.0), ('optimizer_states', 12.0)) x(part, b)) select model, part, round(gb, 6) as gb, round(gb / 80 * 100, 6) as pct_of_vram, part = 'optimizer_states' and gb / 80 * 100 > 40 as large from p")
def k_bill(spark: SparkSession, d: str) -> DataFrame:
    """K7: the fixed parts of one device's bill by architecture."""
    runs = memory_runs(spark).where("batch = 1 and seq = 512 and optimizer = 'adamw' and strategy = 'none'")
    return r6(K.bill(K.breakdown(runs), ["model"]).where(F.col("part").isin("weights", "gradients", "optimizer_states")))


@query("k_activations", f"with m(model, layers, hidden, heads, kv, vocab, params, experts, used) as (values {_MODELS}) select model, b::int as batch, floor(layers * b::double * 2048 * hidden * (10 + 2 * kv::double / heads + case when experts is null then 0 else least(b * 2048 * used, ceil(b * 2048 * used::double / experts * 1.25::double)) / (b * 2048)::double * 4 end) * 2)::bigint as bytes from m, range(1, 9) t(b)")
def k_activations(spark: SparkSession, d: str) -> DataFrame:
    """K3, with and without experts."""
    rows = K.models(spark).withColumn("batch", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("seq", F.lit(2048))
    return rows.select("model", "batch", K.activation_bytes(rows).cast("long").alias("bytes"))


@query("k_prefix_sharing", "select g::bigint as grp, g * 2048::bigint as naive, 1024 + g * 1024::bigint as shared, (g - 1) * 1024::bigint as saved, round((g - 1) * 1024 / (g * 2048) * 100, 6) as saved_pct from range(1, 17) t(g)")
def k_prefix_sharing(spark: SparkSession, d: str) -> DataFrame:
    """K11."""
    parts = K.prefix_sharing(F.col("id"), F.lit(1024), F.lit(1024), F.lit(28), F.lit(2), F.lit(128))
    return r6(spark.range(1, 17).select(F.col("id").alias("grp"), *[parts[k].alias(k) for k in ("naive", "shared", "saved", "saved_pct")]))


@query("k_serving_training", "select * from (select 1540000000::bigint as params) p, (select round(1540000000::double * 2 / 1073741824 + 5.8 + 0.5, 6) as serving, round(1540000000::double * 16 / 1073741824 + 3.0, 6) as training) q")
def k_serving_training(spark: SparkSession, d: str) -> DataFrame:
    """K9 and K10."""
    p = F.col("params")
    return r6(spark.createDataFrame([(1540000000,)], "params long").select("params", K.serving_gb(p, F.lit(5.8)).alias("serving"), K.training_gb(p, F.lit(3.0)).alias("training")))


@query("k_phase_ledger", "select * from (values ('rollout', 23.3::double, true), ('train', 52.2::double, true), ('train', 52.2::double, false)) t(phase, used_gb, ok)")
def k_phase_ledger(spark: SparkSession, d: str) -> DataFrame:
    """K12."""
    rows = spark.createDataFrame([("rollout", 17.5, 5.8, 0.0, 0.0, 0.0), ("train", 17.5, 0.0, 17.5, 8.7, 8.5), ("train", 17.5, 5.8, 17.5, 8.7, 8.5)], "phase string, weights_gb double, kv_gb double, gradients_gb double, optimizer_gb double, activations_gb double")
    return r6(K.phase_ledger(rows).select("phase", "used_gb", "ok"))
