"""Rules of routing, quotas and health as columns: A2 to A8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import words

# Words that mark a kind of task.
REASONING = "prove calculate derive solve math cuda theorem".split()
CENTROIDS = {
    "conversational": "hello hi summary translate capital weather explain overview rephrase format grammar draft".split(),
    "mathematical": "prove calculate derivative integral equation prime matrix vector theorem probability bayes eigenvalue".split(),
    "code": "cuda kernel assembly compiler deadlock mutex simd tensor vram pointer segmentation refactor".split(),
}
DECISIVE = "cuda kernel prove derivative deadlock".split()


def _list(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def shed_by_delay(delay_ms: Column, target_ms: float = 500.0, retry_s: int = 15) -> Column:
    """A2: code and seconds to retry after (null if allowed)."""
    ok = delay_ms <= target_ms
    return F.struct(F.when(ok, 200).otherwise(429).alias("code"), F.when(~ok, retry_s).alias("retry_s"))


def cascade(prompt: Column, saturated: Column, long_words: int = 64) -> Column:
    """A3: lane and whether it is a spill-over. A long prompt without a reasoning word goes to the fast lane if the large one is saturated."""
    w = words(prompt)
    hard, long = F.arrays_overlap(w, _list(REASONING)), F.size(w) > long_words
    return F.struct(F.when((~saturated & (hard | long)) | (saturated & hard), "deep").otherwise("fast").alias("lane"), (saturated & ~hard & ~long).alias("spill"))


def nearest_task(query: Column) -> Column:
    """A4: task, lane and score: share of a query's distinct words that belong to a task; ties go to the first, decisive words to the deep lane; no hit scores 0.85."""
    w = F.array_distinct(words(query))
    n = F.greatest(F.size(w), F.lit(1))
    scores = {k: F.size(F.array_intersect(w, _list(v))) / n for k, v in CENTROIDS.items()}
    best = F.greatest(*scores.values())
    name = F.when(scores["conversational"] == best, "conversational").when(scores["mathematical"] == best, "mathematical").otherwise("code")
    deep = (name != "conversational") | F.arrays_overlap(w, _list(DECISIVE))
    return F.struct(F.when(deep & (best == 0), "code").when(~deep, "conversational").otherwise(name).alias("task"), F.when(deep, "deep").otherwise("fast").alias("lane"), F.when(best > 0, best).otherwise(0.85).alias("score"))


def pod_of(tenant: Column, pods: int) -> Column:
    """A5: the 128 bit md5 modulo the pods, folded in 32 bit parts so that nothing overflows."""
    h = F.md5(tenant)
    out = F.lit(0).cast("long")
    for k in range(4):
        out = F.pmod(out * (2**32 % pods) + F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long"), F.lit(pods))
    return out.cast("int")


def tenant_quota(requests: DataFrame, tenant: str, blocks: str, total: int = 1000, share: float = 0.15) -> DataFrame:
    """Tenant, asked, live: each tenant keeps at most its share of the pool."""
    return requests.groupBy(tenant).agg(F.sum(blocks).alias("asked")).withColumn("live", F.least(F.lit(int(total * share)), F.col("asked")))


def surviving_blocks(allocations: DataFrame, tenant: str, order: list[str], total: int = 1000, share: float = 0.15) -> DataFrame:
    """The newest blocks of each tenant, up to its quota; a tenant's oldest go first."""
    rank = F.row_number().over(Window.partitionBy(tenant).orderBy(*[F.desc(c) for c in order]))
    return allocations.withColumn("_rank", rank).where(F.col("_rank") <= int(total * share)).drop("_rank")


def leak_watch(active: Column, used: Column, total: int = 2000, pinned: int = 120, share: float = 0.15) -> Column:
    """Blocks that stay in use while nothing runs, and the health code that follows."""
    left = F.when(active > 0, 0).otherwise(F.greatest(F.lit(0), used - pinned))
    return F.struct(left.alias("residual"), (left / total * 100).alias("pct"), F.when((active <= 0) & (left >= int(total * share)), 503).otherwise(200).alias("code"))


def primed(users: DataFrame, tenant: str, pods: int, tokens: int = 2500, ms: float = 120.0) -> DataFrame:
    """Users with the pod whose cache is filled for them, and what that takes."""
    return users.withColumns({"pod": pod_of(F.col(tenant), pods), "tokens": F.lit(tokens), "ms": F.lit(ms)})


# Seconds, spot pods, anchor pods, boot progress and absorbed traffic in percent, dropped requests.
HANDOFF = [(0.0, 5, 1, 0.0, 100.0, 0), (1.0, 4, 1, 5.0, 100.0, 0), (2.0, 4, 1, 10.0, 100.0, 0), (22.5, 5, 1, 100.0, 100.0, 0), (30.0, 5, 1, 100.0, 100.0, 0)]


def handoff(spark) -> DataFrame:
    """The timeline of a pod that is taken away with notice."""
    return spark.createDataFrame(HANDOFF, "at_s double, spot int, anchor int, boot_pct double, absorbed_pct double, dropped int")


def command_flags(df: DataFrame, columns: list[str]) -> Column:
    """A10: settings as command-line words, in the order of the columns: names with dashes and values, true switches bare; false and null ones are left out."""
    kinds = dict(df.dtypes)
    words = []
    for c in columns:
        flag = F.lit("--" + c.replace("_", "-"))
        words.append(F.when(F.col(c), F.array(flag)) if kinds[c] == "boolean" else F.when(F.col(c).isNotNull(), F.array(flag, F.col(c).cast("string"))))
    return F.flatten(F.filter(F.array(*words), lambda w: w.isNotNull()))
