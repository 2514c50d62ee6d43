"""Group-relative advantages and evaluations: G1 to G10."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.dpo import transitions

EPSILON = 1e-8


def advantages(df: DataFrame, batch: str, group: str, reward: str) -> DataFrame:
    """Adds group and batch mean and population deviation, advantage and mode.

    Within a group if its rewards differ, else against the whole batch, else 0. Rows without a batch or a group are left out. Moments of groups and batches come from aggregates that are summed before the shuffle and joined
    back, so that neither a large batch nor a large group is gathered in one task."""
    own = df.groupBy(batch, group).agg(F.avg(reward).alias("group_mean"), F.stddev_pop(reward).alias("group_std"))
    all_ = df.groupBy(batch).agg(F.avg(reward).alias("batch_mean"), F.stddev_pop(reward).alias("batch_std"))
    df = df.join(own, [batch, group]).join(all_, batch)
    by_group, by_batch = F.col("group_std") > EPSILON, F.col("batch_std") > EPSILON
    x = F.col(reward)
    value = F.when(by_group, (x - F.col("group_mean")) / (F.col("group_std") + EPSILON)).when(by_batch, (x - F.col("batch_mean")) / (F.col("batch_std") + EPSILON)).otherwise(0.0)
    return df.withColumns({"advantage": value, "mode": F.when(by_group, "intra_group").when(by_batch, "batch_fallback").otherwise("zero_fallback")})


def flat_streaks(batches: DataFrame, run: str, order: str, std: str) -> DataFrame:
    """Adds streak, the number of consecutive batches up to this one without variance. Gaps and islands within a run."""
    w = Window.partitionBy(run).orderBy(order)
    flat = F.col(std) < EPSILON
    island = batches.withColumn("_island", F.sum(F.when(flat, 0).otherwise(1)).over(w))
    return island.withColumn("streak", F.sum(F.when(flat, 1).otherwise(0)).over(Window.partitionBy(run, "_island").orderBy(order))).drop("_island")


def anchored_batches(batches: DataFrame, run: str, order: str, std: str, after: int = 3) -> DataFrame:
    """The batches into which a known good answer goes: from the third flat one in a row on; putting it in ends no streak."""
    return flat_streaks(batches, run, order, std).where(F.col("streak") >= after)


def with_anchor(df: DataFrame, anchored: DataFrame, batch: str, group: str, k: str, completion: str, reward: str, golden: str, golden_reward: float) -> DataFrame:
    """The last completion of the first group of each anchored batch replaced; adds anchored, true for all rows of groups whose completions equal that group's."""
    first = df.groupBy(batch).agg(F.min(group).alias("_g"))
    last = df.join(first, batch).where(F.col(group) == F.col("_g")).groupBy(batch).agg(F.max(k).alias("_k"), F.first("_g").alias("_g"))
    marks = anchored.select(batch).distinct().join(last, batch)
    df = df.join(marks, batch, "left")
    hit = F.coalesce((F.col(group) == F.col("_g")) & (F.col(k) == F.col("_k")), F.lit(False))
    df = df.withColumns({completion: F.when(hit, golden).otherwise(F.col(completion)), reward: F.when(hit, golden_reward).otherwise(F.col(reward)), "_in": F.coalesce(F.col(group) == F.col("_g"), F.lit(False))})
    # groups are the same if their completions are, in order: compared by count and by sums of two hashes of (rank, completion)
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(batch, group).orderBy(k)))
    sums = lambda s: F.sum(F.pmod(F.xxhash64(F.lit(s), "_r", completion), F.lit(1 << 50)))
    keys = ranked.groupBy(batch, group).agg(F.count(F.lit(1)).alias("_n"), sums(1).alias("_s"), sums(2).alias("_t"), F.bool_or("_in").alias("_in0"))
    own = keys.where("_in0").select(batch, "_n", "_s", "_t", F.lit(True).alias("anchored"))
    same = keys.join(own, [batch, "_n", "_s", "_t"], "left").select(batch, group, F.coalesce("anchored", F.lit(False)).alias("anchored"))
    return df.drop("_g", "_k", "_in").join(same, [batch, group])


def wrong_sizes(df: DataFrame, batch: str, group: str, size: int) -> DataFrame:
    """Groups that don't have exactly so many rows."""
    return df.groupBy(batch, group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != size)


def checked(df: DataFrame, batch: str, group: str, size: int) -> DataFrame:
    """Df, or ValueError if a group has another size."""
    bad = wrong_sizes(df, batch, group, size).head()
    if bad:
        raise ValueError(f"group {bad[group]!r} of batch {bad[batch]!r} has {bad['n']} rows, not {size}")
    return df


def evaluation(df: DataFrame, limit: int) -> DataFrame:
    """One row over accurate, format_valid, tokens, reward."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), F.count_if("accurate").alias("correct"), F.count_if("format_valid").alias("formatted"), F.count_if(F.col("tokens") >= limit).alias("at_limit"), F.try_divide(F.count_if("accurate"), n).alias("accuracy"), F.try_divide(F.count_if("format_valid"), n).alias("format_rate"), F.avg("reward").alias("reward"))


def before_after(a: DataFrame, b: DataFrame, key: str, flag: str) -> DataFrame:
    """G8, J1."""
    return transitions(a.withColumnRenamed(flag, "won"), b.withColumnRenamed(flag, "won"), key)


def weight_delta(norms: DataFrame, norm: str) -> DataFrame:
    """G9."""
    return norms.agg(F.sum(norm).alias("total"), F.max(norm).alias("largest"), F.count_if(F.col(norm) > 0).alias("changed"))


def step_flags(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Whether any step had reward variance, and any a gradient."""
    return steps.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("reward_std") > 0), F.lit(False)).alias("varied"), F.coalesce(F.bool_or(F.col("grad_norm") > 0), F.lit(False)).alias("learned"))
