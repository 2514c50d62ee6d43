"""Models of training and serving memory over parameter rows: K1 to K13."""

from __future__ import annotations

import os
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GIB = 1024.0**3

# Architectures by name, in order of preference.
MODELS = [
    ("qwen/qwen2.5-1.5b", 28, 1536, 12, 2, 151936, 1540000000, None, None),
    ("qwen/qwen2.5-7b", 28, 3584, 28, 4, 152064, 7610000000, None, None),
    ("meta-llama/llama-3-8b", 32, 4096, 32, 8, 128256, 8030000000, None, None),
    ("meta-llama/llama-3-70b", 80, 8192, 64, 8, 128256, 70600000000, None, None),
    ("mistralai/mixtral-8x7b", 32, 4096, 32, 8, 32000, 46700000000, 8, 2),
]
MODEL_SCHEMA = "model string, layers int, hidden int, heads int, kv_heads int, vocab int, params long, experts int, experts_used int"
# Memory of devices in GB.
DEVICES = {"l4-24gb": 24.0, "a10g-24gb": 24.0, "a100-40gb": 40.0, "a100-80gb": 80.0, "h100-80gb": 80.0, "t4-16gb": 16.0, "v100-16gb": 16.0, "v100-32gb": 32.0}


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *m) for k, m in enumerate(MODELS)], "preference int, " + MODEL_SCHEMA)


def resolved_models(names: DataFrame, spark: SparkSession) -> DataFrame:
    """K1: each name with the first architecture whose name holds it or that it holds, whatever the case; null columns if there is none. The presets are a handful of rows."""
    n = names.select("name").distinct()
    low, preset = F.lower("name"), F.col("model")
    hits = n.join(F.broadcast(models(spark)), F.contains(low, preset) | F.contains(preset, low), "left")
    best = F.min_by(F.struct("model", "layers", "hidden", "heads", "kv_heads", "vocab", "params", "experts", "experts_used"), "preference")
    return hits.groupBy("name").agg(best.alias("m")).select("name", "m.*")


def device_gb(name: Column) -> Column:
    """K2: memory by name, else the number before "gb", else 24."""
    table = F.create_map(*[F.lit(x) for kv in DEVICES.items() for x in kv])
    low = F.lower(name)
    return F.coalesce(F.try_element_at(table, low), F.expr("null").cast("double"), F.nullif(F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*gb", 1), F.lit("")).cast("double"), F.lit(24.0))


def activation_bytes(m: DataFrame, checkpointing: bool = True, bytes_each: int = 2, capacity: float = 1.25) -> Column:
    """K3: activations of batch rows of seq tokens. Experts add what a full expert holds: ceil of its share times the capacity, at most all."""
    ratio = F.greatest("kv_heads", F.lit(1)) / F.greatest("heads", F.lit(1))
    factor = 10 + 2 * ratio if checkpointing else 34 + 4 * ratio
    t = F.col("batch") * F.col("seq")
    most = F.least(t * F.col("experts_used"), F.ceil(t * F.col("experts_used") / F.col("experts") * capacity))
    factor = factor + F.when(F.col("experts").isNotNull(), most / F.greatest(t, F.lit(1)) * 4.0).otherwise(0.0)
    return F.floor(F.col("layers") * t.cast("double") * F.col("hidden") * factor * bytes_each)


def communication_bytes(strategy: Column, world: Column, hidden: Column, batch: Column, seq: Column, buffer: int = 4 << 20, channels: int = 8, bucket: int = 25 << 20, gather: int = 500_000_000, reduce: int = 500_000_000, bytes_each: int = 2) -> Column:
    """K4: none for one device; else ring buffers and what the strategy holds."""
    ring = F.lit(2 * buffer * channels).cast("long") * F.least(F.lit(2), F.greatest(world - 1, F.lit(1)))
    extra = F.when(F.contains(strategy, F.lit("zero3")), gather + reduce).when(F.contains(strategy, F.lit("tensor_parallel")), 2 * batch.cast("long") * seq * hidden * bytes_each).when(F.contains(strategy, F.lit("ddp")), bucket).otherwise(0)
    return F.when(world <= 1, F.lit(0)).otherwise(ring + extra).cast("long")


def breakdown(runs: DataFrame, checkpointing: bool = True) -> DataFrame:
    """K5: adds the five parts in GB, their total, headroom, fit and utilisation.

    runs: the columns of an architecture, and batch, seq, optimizer, strategy, world, vram_gb. ZeRO-3 shares the first three parts among the devices."""
    shared = F.when(F.contains(F.lower("strategy"), F.lit("zero3")) & (F.col("world") > 1), F.col("world")).otherwise(1)
    opt = F.when(F.lower("optimizer").rlike("8bit|sgd"), 4).otherwise(12)
    part = lambda b: F.floor(F.col("params") * b / shared)
    df = runs.withColumns({"weights": part(F.lit(2)), "gradients": part(F.lit(2)), "optimizer_states": part(opt), "activations": activation_bytes(runs, checkpointing), "communication": communication_bytes(F.lower("strategy"), F.col("world"), F.col("hidden"), F.col("batch"), F.col("seq"))})
    names = ["weights", "gradients", "optimizer_states", "activations", "communication"]
    total = sum((F.col(n).cast("double") for n in names), F.lit(0.0)) / GIB
    df = df.withColumn("total_gb", total)
    df = df.withColumns({f"{n}_gb": F.col(n) / GIB for n in names} | {"headroom_gb": F.col("vram_gb") - F.col("total_gb"), "fits": F.col("total_gb") <= F.col("vram_gb"), "utilisation": F.coalesce(F.try_divide(F.col("total_gb"), F.col("vram_gb")) * 100, F.lit(0.0))})
    return df.drop(*names)


def usable_gb(vram: Column, calibrated: Column) -> Column:
    """K6."""
    return vram * F.when(calibrated, 0.95).otherwise(0.85)


def largest_part(df: DataFrame) -> Column:
    """K7: name of the largest part; ties go to the one listed first."""
    order = ["optimizer_states", "activations", "weights", "gradients", "communication"]
    most = F.greatest(*[F.col(f"{n}_gb") for n in order])
    out = F.lit(order[-1])
    for n in reversed(order[:-1]):
        out = F.when(F.col(f"{n}_gb") == most, n).otherwise(out)
    return out


PARTS = ("weights", "gradients", "optimizer_states", "activations", "communication")
# Shares of the device's memory above which optimizer states and activations stand out, shares of the total that make them the cause, waste that makes padding it, and what 8 bit states save.
LARGE = {"optimizer_states": 40.0, "activations": 30.0}
CAUSE = {"optimizer_states": 0.45, "activations": 0.35}
WASTED, SAVED = 30.0, 8 / 12


def bill(df: DataFrame, keys: list[str]) -> DataFrame:
    """K7: keys, part, gb, pct_of_vram, large for each of the five parts of breakdown()."""
    parts = [F.struct(F.lit(n).alias("part"), F.col(f"{n}_gb").alias("gb"), F.coalesce(F.try_divide(F.col(f"{n}_gb"), F.col("vram_gb")) * 100, F.lit(0.0)).alias("pct_of_vram")) for n in PARTS]
    out = df.select(*keys, F.explode(F.array(*parts)).alias("x")).select(*keys, "x.*")
    large = F.lit(False)
    for n, most in LARGE.items():
        large = large | (F.col("part") == n) & (F.col("pct_of_vram") > most)
    return out.withColumn("large", large)


def cause(df: DataFrame, checkpointing: bool = True, waste_pct: Column | None = None) -> DataFrame:
    """K7: adds cause and freed_gb to rows of breakdown(): what to change first. Full optimizer states that are much of the total (freed_gb: what 8 bit ones save), else padding, else activations that aren't recomputed, else nothing stands out."""
    states = (F.col("optimizer_states_gb") > F.col("total_gb") * CAUSE["optimizer_states"]) & ~F.lower("optimizer").contains("8bit")
    padded = F.coalesce(waste_pct > WASTED, F.lit(False)) if waste_pct is not None else F.lit(False)
    kept = F.lit(not checkpointing) & (F.col("activations_gb") > F.col("total_gb") * CAUSE["activations"])
    name = F.when(states, "optimizer_states").when(padded, "padding").when(kept, "activations").otherwise("balanced")
    return df.withColumns({"cause": name, "freed_gb": F.when(states, F.col("optimizer_states_gb") * SAVED)})


def penalised(length: Column, factor: Column | float) -> Column:
    """A length times the storage's factor, half to even."""
    return F.bround(length * factor).cast("long")


def cumulative_risk(p: Column, steps: Column) -> Column:
    """K7: chance of at least one failure, in percent."""
    return (1 - F.pow(1 - p, steps)) * 100


def efficiency(utilisation: Column, waste: Column) -> Column:
    """K8: half the clamped utilisation and half the share of useful tokens; waste counts as 20 where unknown."""
    return 0.5 * F.least(F.lit(100.0), F.greatest(F.lit(0.0), utilisation)) + 0.5 * F.greatest(F.lit(0.0), 100 - F.coalesce(waste, F.lit(20.0)))


def grade(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").otherwise("D")


def upscaled_batch(batch: Column, utilisation: Column, headroom: Column) -> Column:
    """K8: a larger batch where much memory is free, else null."""
    u = F.least(F.lit(100.0), F.greatest(F.lit(0.0), utilisation))
    return F.when((u < 60) & (headroom >= 6), F.greatest(batch + 4, F.floor(batch * 85.0 / F.greatest(u, F.lit(10.0)))))


def parameter_bytes(params: Column, bytes_each: int = 2) -> Column:
    """K9, by the formula."""
    return params * bytes_each


def serving_gb(params: Column, kv_gb: Column) -> Column:
    """Weights, cache and half a GB."""
    return params * 2 / GIB + kv_gb + 0.5


def training_gb(params: Column, activations_gb: Column) -> Column:
    """16 bytes a parameter and activations."""
    return params * 16 / GIB + activations_gb


def prefix_sharing(group: Column, prompt: Column, answer: Column, layers: Column, kv_heads: Column, head_dim: Column, bytes_each: int = 2) -> dict[str, Column]:
    """Tokens without and with a shared prompt, what is saved, and its bytes."""
    naive, shared = group * (prompt + answer), prompt + group * answer
    return {"naive": naive, "shared": shared, "saved": naive - shared, "saved_pct": F.coalesce(F.try_divide(naive - shared, naive) * 100, F.lit(0.0)), "prompt_saved_pct": F.coalesce(F.try_divide((group - 1) * prompt, group * prompt) * 100, F.lit(0.0)), "saved_bytes": (naive - shared).cast("long") * 2 * layers * kv_heads * head_dim * bytes_each}


def phase_ledger(df: DataFrame) -> DataFrame:
    """Adds used_gb and ok to rows of phase (rollout, train), weights_gb, kv_gb, gradients_gb, optimizer_gb, activations_gb: training needs an empty cache."""
    used = F.when(F.col("phase") == "rollout", F.col("weights_gb") + F.col("kv_gb")).otherwise(F.col("weights_gb") + F.col("gradients_gb") + F.col("optimizer_gb") + F.col("activations_gb"))
    return df.withColumns({"used_gb": used, "ok": (F.col("phase") == "rollout") | (F.col("kv_gb") == 0)})


class StorageTooSlow(RuntimeError):
    """A file's storage answers too slowly and there is no signature to fall back on."""


def storage_penalty(path: str, cached: bool, limit_ms: float = 1500.0, factor: float = 1.10, clock=time.perf_counter, stat=os.stat) -> float:
    """Factor for lengths: 1 if the file's storage answers in time, else `factor` with a cached signature, else StorageTooSlow. A missing file raises FileNotFoundError."""
    began = clock()
    stat(path)
    if (clock() - began) * 1000 <= limit_ms:
        return 1.0
    if not cached:
        raise StorageTooSlow(path)
    return factor
