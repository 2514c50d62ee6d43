"""Schedules and traces of requests: V12 to V14, S9. Schedules are short and drawn on the driver, so that a seed gives the same numbers everywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import stored


def poisson_count(n: int, rate: float, seed: int = 42) -> list[float]:
    """N arrival times, the first at 0; all 0 without a rate."""
    if n <= 0:
        return []
    if rate <= 0:
        return [0.0] * n
    gaps = np.random.default_rng(seed).exponential(1 / rate, n)
    gaps[0] = 0.0
    return np.cumsum(gaps).tolist()


def poisson_window(seconds: float, rate: float, seed: int = 42) -> list[float]:
    """Arrival times before the end of a window; the first gap counts."""
    return varying(seconds, lambda t: rate, seed)


def burst(seconds: float, base: float, high: float, start: float = 20.0, end: float = 30.0, seed: int = 42) -> list[float]:
    """The rate of each gap is that of the time at which it starts."""
    return varying(seconds, lambda t: high if start <= t < end else base, seed)


def varying(seconds: float, rate_at, seed: int = 42) -> list[float]:
    rng, t, out = np.random.default_rng(seed), 0.0, []
    while (rate := rate_at(t)) > 0:
        t += rng.exponential(1 / rate)
        if t >= seconds:
            break
        out.append(t)
    return out


def as_trace(spark: SparkSession, times: list[float]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(times)), "request_id long, at_s double")


def generated_trace(spark: SparkSession, n: int, rate: float, topics: list[str], filler: str = "Give details.", seed: int = 42) -> DataFrame:
    """request_id, prompt, prompt_tokens, arrival_offset_s of any number of requests, made in the tasks: topics in turn with one to four fillers, exponential gaps from a hash of the seed, summed up by parts."""
    from millrace.functions.text import tokens_quarter

    rows = spark.range(n).select(F.col("id").alias("request_id"))
    fill = F.repeat(F.lit(" " + filler), F.least(F.lit(4), (F.col("request_id") % 6 + 1).cast("int")))
    rows = rows.withColumn("prompt", F.concat(F.element_at(F.array(*[F.lit(t) for t in topics]), (F.col("request_id") % len(topics) + 1).cast("int")), fill))
    u = (F.pmod(F.xxhash64("request_id", F.lit(seed)), F.lit(1 << 40)) + 1) / float(1 << 40)
    return cumulative(rows.withColumns({"prompt_tokens": tokens_quarter(F.col("prompt")), "gap": -F.log(u) / rate}), "request_id", "gap").withColumn("arrival_offset_s", F.round("upto", 4)).drop("gap", "upto")


def cumulative(df: DataFrame, order: str, value: str) -> DataFrame:
    """Adds upto, the sum of a column over all rows up to this one, by range parts, each shifted by the parts before it."""
    parts = stored(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "cumulative")  # read twice, so made once
    base = parts.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = base.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(F.broadcast(before), "_part").withColumn("upto", F.sum(value).over(w) + F.col("_before")).drop("_part", "_s", "_before")


def little(rate: Column, seconds: Column) -> Column:
    return rate * seconds
