"""Batches by length, their padding, and simulations of it: B1 to B13."""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.stats import distribution, percentiles, sample_std


def length_sorted_batches(df: DataFrame, length: str, ordinal: str, batch_size: int) -> DataFrame:
    """B2: ordinal, len, batch_id, place: rows by length, ties by ordinal, cut into batches.

    A row's rank is the number of shorter rows, from counts by length, plus its rank among its equals, from a dense ordinal of (length, ordinal) made by a range sort; there is no window over all rows."""
    from millrace.operators.sft import dense_ordinal

    rows = df.select(F.col(ordinal).alias("ordinal"), F.col(length).alias("len"), F.struct(F.col(length), F.col(ordinal)).alias("_key"))
    ranked = dense_ordinal(rows, "_key", "rank").drop("_key")
    return ranked.select("ordinal", "len", F.floor(F.col("rank") / batch_size).alias("batch_id"), (F.col("rank") % batch_size).cast("int").alias("place"))


def by_length(df: DataFrame, length: str) -> DataFrame:
    """len, n, upto, total, longest: counts by length, summed upwards. The window runs over distinct lengths only."""
    upto, whole = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    counts = df.groupBy(F.col(length).cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("len", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("total"), F.max("len").over(whole).alias("longest"))


def packed_padding(df: DataFrame, length: str, batch_size: int, drop_last: bool = False) -> DataFrame:
    """Useful, packed: tokens of length-sorted batches with padding, from the histogram alone. An empty table gives zeros. drop_last leaves a short last batch out of packed, not of useful."""
    h, b = by_length(df, length), batch_size
    full = F.sum(F.col("len") * b * (F.floor(F.col("upto") / b) - F.floor((F.col("upto") - F.col("n")) / b)))
    rest = F.lit(0) if drop_last else F.max(F.col("total") % b) * F.max("longest")
    return h.agg(F.coalesce(F.sum(F.col("len") * F.col("n")), F.lit(0)).alias("useful"), F.coalesce(full + rest, F.lit(0)).cast("long").alias("packed"))


def expected_random_padding(df: DataFrame, length: str, batch_size: int, drop_last: bool = False) -> DataFrame:
    """Random: expected tokens of random batches with padding, exactly, from the histogram.

    A batch of k costs k times the expected maximum of k lengths drawn without replacement; P(max <= l) = C(F(l), k) / C(n, k), as a product of k ratios."""
    h = by_length(df, length)

    def cost(k: int, batches: Column) -> Column:
        def below(upto: Column) -> Column:  # P(all k are among the `upto` shortest)
            p = F.lit(1.0)
            for i in range(k):
                p = p * F.greatest(upto - i, F.lit(0)) / F.greatest(F.col("total") - i, F.lit(1))
            return p

        return F.sum(F.col("len") * (below(F.col("upto")) - below(F.col("upto") - F.col("n")))) * k * batches

    b, n = batch_size, F.max("total")
    total = cost(b, F.floor(n / b))
    for k in range(1, 1 if drop_last else b):
        total = total + F.when(n % b == k, cost(k, F.lit(1))).otherwise(0.0)
    return h.agg(F.coalesce(total, F.lit(0.0)).alias("random"))


def packing_metrics(df: DataFrame, length: str, batch_size: int, drop_last: bool = False) -> DataFrame:
    """Useful, packed, random, waste of both in percent, what packing saves, all at least 0. The baseline is the exact expectation."""
    one = packed_padding(df, length, batch_size, drop_last).withColumn("one", F.lit(1)).join(expected_random_padding(df, length, batch_size, drop_last).withColumn("one", F.lit(1)), "one").drop("one")
    share = lambda x: F.coalesce(F.greatest(F.try_divide(x - F.col("useful"), x) * 100, F.lit(0.0)), F.lit(0.0))
    one = one.withColumns({"packed_waste": share(F.col("packed")), "random_waste": share(F.col("random"))})
    saved = F.coalesce(F.greatest(F.try_divide(F.col("random") - F.col("packed"), F.col("random")) * 100, F.lit(0.0)), F.lit(0.0))
    gain = F.coalesce(F.greatest((F.try_divide(F.col("random"), F.col("packed")) - 1) * 100, F.lit(0.0)), F.lit(0.0))
    return one.withColumns({"waste_reduction": F.greatest(F.col("random_waste") - F.col("packed_waste"), F.lit(0.0)), "tokens_saved_pct": saved, "density_gain_pct": gain, "baseline": F.lit("exact_expectation")})


def translated_batch(batch: Column, accumulation: Column) -> Column:
    """Half the batch and twice the accumulation for even batches; odd ones stay."""
    even = batch % 2 == 0
    return F.struct(F.when(even, (batch / 2).cast("int")).otherwise(batch).alias("batch"), F.when(even, accumulation * 2).otherwise(accumulation).alias("accumulation"))


def max_distribution(df: DataFrame, length: str, batch_size: int, budget: int | None = None) -> DataFrame:
    """B7 exactly: one row: expected longest of k = min(n, batch_size) rows drawn without replacement, padding waste of the batch, probability that the padded batch is over budget, expected step of the first breach.

    Batches are padded to batch_size rows even where only k are drawn."""
    h = by_length(df, length)
    n = F.col("total")
    k = F.least(n, F.lit(batch_size))

    def below(upto: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), k.cast("int") - 1), F.lit(1.0), lambda p, i: p * F.greatest(upto - i, F.lit(0)) / F.greatest(n - i, F.lit(1)))

    h = h.withColumn("p", below(F.col("upto")) - below(F.col("upto") - F.col("n")))
    over = F.lit(0.0) if budget is None else F.coalesce(F.sum(F.when(F.col("len") * batch_size > budget, F.col("p"))), F.lit(0.0))
    one = h.agg(F.sum(F.col("len") * F.col("p")).alias("mean_longest"), F.max("longest").alias("worst"), (F.sum(F.col("len") * F.col("n")) / F.max(n) * F.max(k)).alias("mean_useful"), over.alias("p_over"))
    padded = F.col("mean_longest") * batch_size
    return one.withColumns({"mean_padded": padded, "worst_padded": F.col("worst") * batch_size, "waste_pct": F.greatest(F.try_divide(padded - F.col("mean_useful"), padded), F.lit(0.0)) * 100, "first_breach": F.when(F.col("p_over") > 0, F.round(1 / F.col("p_over")).cast("long"))})


def simulated_padding(df: DataFrame, length: str, batch_size: int, trials: int = 1000, seed: int = 42, budget: int | None = None) -> DataFrame:
    """B7 by simulation: trial, longest, padded, useful of random batches.

    Lengths are drawn from the histogram of the whole table, which is bounded by the longest length and is all that a task gets; each trial has its own seed."""
    h = by_length(df, length).select("len", "n").orderBy("len").toPandas()
    lens, counts = h["len"].to_numpy(np.int64), h["n"].to_numpy(np.int64)
    shared = df.sparkSession.sparkContext.broadcast((lens, counts))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lens, counts = shared.value
        total = int(counts.sum())
        k = min(total, batch_size)
        ends = np.cumsum(counts)
        for b in batches:
            rows = []
            for trial in b["id"]:
                rng = np.random.default_rng([seed, int(trial)])
                picked = np.zeros(0, np.int64)
                while len(picked) < k:  # distinct places; few repeats occur where k is small beside the total
                    picked = np.unique(np.concatenate([picked, rng.integers(0, total, k - len(picked))]))
                drawn = lens[np.searchsorted(ends, picked, "right")]
                rows.append((int(trial), int(drawn.max()), int(drawn.max()) * batch_size, int(drawn.sum())))
            yield pd.DataFrame(rows, columns=["trial", "longest", "padded", "useful"])

    return df.sparkSession.range(trials if len(lens) else 0).mapInPandas(draw, "trial long, longest long, padded long, useful long")


def shuffled_totals(df: DataFrame, length: str, sizes: tuple[int, ...], shuffles: int = 1000, seed: int = 42, drop_last: bool = False, block: int = 1 << 20) -> DataFrame:
    """Trial, batch_size, total: tokens with padding of the whole table shuffled and cut into batches; one shuffle serves all sizes.

    A shuffle is drawn in blocks of about `block` rows, each block's lengths from what the histogram still has, so a task holds a block and the histogram whatever the table's size; each trial has its own seed. The drawing ends at 10^9 rows."""
    h = by_length(df.where(F.col(length).isNotNull()), length).select("len", "n").orderBy("len").toPandas()
    shared = df.sparkSession.sparkContext.broadcast((h["len"].to_numpy(np.int64), h["n"].to_numpy(np.int64)))
    sizes, step = tuple(sorted(set(sizes))), math.lcm(*sizes)
    rows = max(1, block // step) * step

    def totals(lens: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> list[int]:
        left, n, out = counts.copy(), int(counts.sum()), dict.fromkeys(sizes, 0)
        while n:
            k = min(rows, n)
            drawn = left if k == n else rng.multivariate_hypergeometric(left, k, method="marginals")
            left, n = left - drawn, n - k
            values = np.repeat(lens, drawn)
            rng.shuffle(values)
            longest = {1: np.concatenate([values, np.zeros(-k % step, np.int64)])}
            for b in sizes:
                part = max(x for x in longest if b % x == 0)
                longest[b] = np.maximum.reduce([longest[part][j :: b // part] for j in range(b // part)])
                whole, rest = divmod(k, b)
                out[b] += int(longest[b][:whole].sum()) * b + (int(longest[b][whole]) * rest if rest and not drop_last else 0)
        return [out[b] for b in sizes]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for trial in batch["id"]:
                yield pd.DataFrame({"trial": int(trial), "batch_size": np.array(sizes, np.int32), "total": np.array(totals(*shared.value, np.random.default_rng([seed, int(trial)])), np.int64)})

    return df.sparkSession.range(shuffles if len(h) else 0).mapInPandas(draw, "trial long, batch_size int, total long")


def batch_size_sweep(df: DataFrame, length: str, sizes: tuple[int, ...] = (2, 4, 8, 16), shuffles: int = 1000, seed: int = 42, drop_last: bool = False) -> DataFrame:
    """packing_metrics() for several batch sizes, and the spread of shuffled totals: shuffles, shuffled_mean, _std (population), _min, _max, _p05, _p95.

    random is the exact expectation that shuffled_mean comes near to. With drop_last a short last batch costs nothing anywhere, while useful has all rows, as in the reference."""
    out = None
    for b in sizes:
        part = packing_metrics(df, length, b, drop_last).withColumn("batch_size", F.lit(b))
        out = part if out is None else out.unionByName(part)
    t, low_high = F.col("total"), percentiles(F.col("total"), [0.05, 0.95])
    spread = shuffled_totals(df, length, sizes, shuffles, seed, drop_last).groupBy("batch_size").agg(
        F.count(t).alias("shuffles"), F.avg(t).alias("shuffled_mean"), F.stddev_pop(t).alias("shuffled_std"), F.min(t).alias("shuffled_min"), F.max(t).alias("shuffled_max"), low_high[0].alias("shuffled_p05"), low_high[1].alias("shuffled_p95"),
    )
    # one row for each size
    return out.join(F.broadcast(spread), "batch_size", "left").withColumn("shuffles", F.coalesce("shuffles", F.lit(0)))


def built_batches(df: DataFrame, length: str, ordinal: str, batch_size: int, grouped: bool, seed: int = 42) -> DataFrame:
    """Ordinal, batch_id, order: random batches, or length-sorted ones; both in an order given by a hash of the seed."""
    if grouped:
        rows = length_sorted_batches(df, length, ordinal, batch_size).select("ordinal", "batch_id")
    else:
        from millrace.operators.sft import dense_ordinal

        mixed = df.select(F.col(ordinal).alias("ordinal"), F.struct(F.xxhash64(F.col(ordinal), F.lit(seed)), F.col(ordinal)).alias("_key"))
        rows = dense_ordinal(mixed, "_key", "rank").select("ordinal", F.floor(F.col("rank") / batch_size).alias("batch_id"))
    return rows.withColumn("order", F.xxhash64("batch_id", F.lit(seed)))


def file_signature(path: str, tokenizer: str, tail: int = 64 * 1024) -> str:
    """A hash of size, time of change, tokenizer and the file's last bytes."""
    stat = os.stat(path)
    with open(path, "rb") as f:
        f.seek(max(0, stat.st_size - tail))
        own = f.read()
    h = hashlib.sha256()
    for part in (str(stat.st_size), str(stat.st_mtime_ns), tokenizer):
        h.update(part.encode() + b"\0")
    h.update(own)
    return h.hexdigest()


def content_signature(df: DataFrame, columns: list[str]) -> DataFrame:
    """B10 for a table: one row: rows and an order-free sum of row hashes."""
    h = F.xxhash64(*columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 40))), F.lit(0)).alias("sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("mixed"))


def dataset_signature(df: DataFrame, length: str) -> DataFrame:
    """One row: count, total, population deviation and percentiles of lengths. The histogram is stats.histogram()."""
    x = F.col(length)
    d = distribution(x)
    return df.agg(F.count(x).alias("n"), F.sum(x).alias("total"), d["mean"].alias("mean"), d["std"].alias("std"), F.min(x).alias("shortest"), F.max(x).alias("longest"), d["p50"].alias("p50"), d["p90"].alias("p90"), d["p95"].alias("p95"), d["p99"].alias("p99"), F.percentile(x, F.lit(0.999)).alias("p999"))


def stride_sample(df: DataFrame, ordinal: str, rows: int, most: int = 1000) -> DataFrame:
    """Every (rows // most)-th row by a dense ordinal, at most `most`."""
    step = max(1, rows // most)
    return df.where((F.col(ordinal) % step == 0) & (F.col(ordinal) < step * most))


def throughput(df: DataFrame, warm_up: int = 5) -> DataFrame:
    """One row from steps (step, useful, padded, seconds, loss): useful tokens a second over all and after the warm-up, waste, mean, first and last loss."""
    late = F.col("step") >= warm_up
    return df.agg(
        F.try_divide(F.sum("useful"), F.sum("seconds")).alias("overall"), F.try_divide(F.sum(F.when(late, F.col("useful"))), F.sum(F.when(late, F.col("seconds")))).alias("steady"),
        (F.try_divide(F.sum("padded") - F.sum("useful"), F.sum("padded")) * 100).alias("waste_pct"), F.avg("loss").alias("mean_loss"), F.min_by("loss", "step").alias("first_loss"), F.max_by("loss", "step").alias("last_loss"),
    )


def paired_deltas(df: DataFrame, pair: str, arm: str, measures: list[str], base: str, other: str) -> DataFrame:
    """Measure, pairs, mean, std: relative differences of two arms within each pair, with the sample deviation (0 for one pair)."""
    a = df.where(F.col(arm) == base).select(pair, *[F.col(m).alias(f"a_{m}") for m in measures])
    b = df.where(F.col(arm) == other).select(pair, *[F.col(m).alias(f"b_{m}") for m in measures])
    both = a.join(b, pair)
    long = both.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.try_divide(F.col(f"a_{m}") - F.col(f"b_{m}"), F.col(f"a_{m}")).alias("delta")) for m in measures])).alias("x")).select("x.*")
    return long.groupBy("measure").agg(F.count("delta").alias("pairs"), F.avg("delta").alias("mean"), sample_std(F.col("delta")).alias("std"))


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
