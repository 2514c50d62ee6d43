"""Statistics with their degrees of freedom and interpolation named."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile(c: Column, q: float) -> Column:
    """Exact, linear between ranks."""
    return F.percentile(c, F.lit(q))


def percentiles(c: Column, qs: list[float]) -> list[Column]:
    """Several at once: Spark keeps one map of values for all of them."""
    together = F.percentile(c, F.array(*[F.lit(q) for q in qs]))
    return [together[k] for k in range(len(qs))]


def mean_pop_std(c: Column) -> tuple[Column, Column]:
    return F.avg(c), F.stddev_pop(c)


def sample_std(c: Column) -> Column:
    """With n - 1; 0 for a single value, null for none."""
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))


def distribution(c: Column) -> dict[str, Column]:
    """Mean, population standard deviation, least, percentiles and most; nulls don't count, no value gives nulls."""
    out = {"mean": F.avg(c), "std": F.stddev_pop(c), "min": F.min(c).cast("double")}
    qs = (10, 25, 50, 75, 90, 95, 99)
    out |= {f"p{q}": x for q, x in zip(qs, percentiles(c, [q / 100 for q in qs]))}
    return out | {"max": F.max(c).cast("double")}


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """bin, n: equal bins between least and most, the last one closed; a single value gets a range of one around it. Empty bins have no row."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    # the one row of bounds is known to be one
    return df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.lit(1).alias("one")).join(F.broadcast(ends.withColumn("one", F.lit(1))), "one").groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def ks_statistic(a: DataFrame, b: DataFrame) -> DataFrame:
    """d, n, m: two-sample Kolmogorov-Smirnov distance of two columns `v`, from counts by value; the window runs over distinct values only."""
    both = a.select(F.col("v").cast("double"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(F.col("v").cast("double"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    by_value = both.where(F.col("v").isNotNull()).groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    upto, whole = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    cdf = by_value.select(F.sum("x").over(upto).alias("cx"), F.sum("y").over(upto).alias("cy"), F.sum("x").over(whole).alias("n"), F.sum("y").over(whole).alias("m"))
    return cdf.agg(F.max(F.abs(F.try_divide(F.col("cx"), F.col("n")) - F.try_divide(F.col("cy"), F.col("m")))).alias("d"), F.max("n").alias("n"), F.max("m").alias("m"))


def ks_p_value(d: float, n: int, m: int, exact_upto: int = 10_000) -> float:
    """P-value of a two-sample distance: by counting lattice paths for small samples, else the limit distribution."""
    if not n or not m or d is None:
        return 1.0
    if max(n, m) <= exact_upto and n * m <= 4_000_000:
        g = math.gcd(n, m)
        h = round(d * n * m / g)  # paths that stay closer than this to the diagonal, as a share of all
        if h == 0:
            return 1.0
        row = [0.0] * (m + 1)
        for i in range(n + 1):
            for j in range(m + 1):
                if i == 0 and j == 0:
                    row[0] = 1.0
                    continue
                inside = abs(i * (m // g) - j * (n // g)) < h
                share = (row[j] * i / (i + j) if i else 0.0) + (row[j - 1] * j / (i + j) if j else 0.0)
                row[j] = share if inside else 0.0
        return min(1.0, max(0.0, 1.0 - row[m]))
    x = d * math.sqrt(n * m / (n + m))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


#: Accuracy of the sketch that brackets a percentile; its rank error is at most one in so many.
ACCURACY = 10_000
#: Groups of up to so many values are ranked whole.
SMALL = 20_000
#: Groups whose brackets (some 100 bytes a value and quantile) are broadcast; more are joined by shuffle.
SMALL_GROUPS = 100_000


def exact_percentiles(df: DataFrame, keys: list[str], values: dict[str, Column], qs: tuple[float, ...], small: int = SMALL, accuracy: int = ACCURACY, fixed: bool = False) -> DataFrame:
    """keys, and for each name in values `name_n` and `name`, an array: exact percentiles, linear between ranks, of groups of any size.

    The aggregate percentile() keeps all of a group's distinct values in one buffer. Here a sketch with a known rank error gives a bracket around each percentile, one pass counts what is below it and how often each value within it occurs, and only
    these few are ranked. Always the same number of passes, whatever the values. Nulls and NaN don't count, infinite values do; a group without values has n 0 and null for an array; a null key is a group; an empty table gives no rows. fixed: df is a table or a checkpoint already, and need not be written for the three passes over it.
    """
    from millrace.session import cut

    names, m = list(values), len(qs)
    columns = {name: c.cast("double") for name, c in values.items()}
    rows = df.select(*keys, *[F.when(~F.isnan(c), c).alias(name) for name, c in columns.items()])
    rows = rows if fixed else cut(rows)
    slack = 3 / accuracy
    sides = F.array(*[F.lit(max(0.0, q - slack)) for q in qs], *[F.lit(min(1.0, q + slack)) for q in qs])
    first = [x for name in names for x in (F.count(name).alias(f"{name}_n"), F.percentile_approx(name, sides, accuracy).alias(f"_{name}_at"), F.min(name).alias(f"_{name}_min"), F.max(name).alias(f"_{name}_max"))]
    brackets = cut(rows.groupBy(*keys).agg(*first))
    of = brackets.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    if brackets.count() <= SMALL_GROUPS:
        of = F.broadcast(of)
    on = [rows[k].eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    met = (rows.join(of, on) if keys else rows.crossJoin(of)).drop(*[f"_of_{k}" for k in keys])  # without keys there is one row of brackets
    few = lambda name: F.col(f"{name}_n") <= max(small, 2 * accuracy)  # of fewer values the slack is no whole rank
    low = lambda name, k: F.col(f"_{name}_min") if qs[k] <= slack else F.col(f"_{name}_at")[k]
    high = lambda name, k: F.col(f"_{name}_max") if qs[k] >= 1 - slack else F.col(f"_{name}_at")[m + k]
    found = []
    for name in names:
        entry = lambda k: F.struct(F.lit(name).alias("_x"), F.lit(k).alias("_k"), F.col(name).alias("_v"))  # noqa: B023, E731
        found += [F.when(few(name) & F.col(name).isNotNull(), entry(-1)), *[F.when(~few(name) & (F.col(name) >= low(name, k)) & (F.col(name) <= high(name, k)), entry(k)) for k in range(m)]]
    inside = met.select(*keys, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("_e")).groupBy(*keys, "_e._x", "_e._k", "_e._v").agg(F.count(F.lit(1)).alias("_c"))
    below = met.groupBy(*keys).agg(*[F.count_if(~few(name) & (F.col(name) < low(name, k))).alias(f"_{name}_{k}") for name in names for k in range(m)])
    order = Window.partitionBy(*keys, "_x", "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_upto", F.sum("_c").over(order))
    base = brackets.join(below.withColumnsRenamed({k: f"_of_{k}" for k in keys}), [brackets[k].eqNullSafe(F.col(f"_of_{k}")) for k in keys], "left").drop(*[f"_of_{k}" for k in keys]) if keys else brackets.crossJoin(below)
    flat = base.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), F.col(f"{name}_n").alias("_n"), F.array(*[F.col(f"_{name}_{k}") for k in range(m)]).alias("_below")) for name in names])).alias("_b")).select("*", "_b.*").drop("_b")
    both = ranked.join(flat, [ranked[k].eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [ranked["_x"] == F.col("_name")])
    picked = []
    for k, q in enumerate(qs):
        own = F.when(F.col("_k").isin(-1, k), F.col("_v"))
        upto = F.col("_upto") + F.when(F.col("_k") == k, F.col("_below")[k]).otherwise(0)
        at = q * (F.col("_n") - 1)
        picked += [F.min(F.when(upto > F.floor(at), own)).alias(f"_low{k}"), F.min(F.when(upto > F.ceil(at), own)).alias(f"_high{k}"), F.first(at - F.floor(at)).alias(f"_part{k}")]
    each = both.groupBy(*keys, "_x").agg(*picked)
    value = lambda k: F.when(F.col(f"_low{k}") == F.col(f"_high{k}"), F.col(f"_low{k}")).otherwise(F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * F.col(f"_part{k}"))
    wide = each.select(*keys, "_x", F.array(*[value(k) for k in range(m)]).alias("_a")).groupBy(*keys).pivot("_x", names).agg(F.first("_a"))
    out = brackets.select(*keys, *[f"{name}_n" for name in names])
    wide = wide.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    return (out.join(wide, [out[k].eqNullSafe(F.col(f"_of_{k}")) for k in keys], "left") if keys else out.crossJoin(wide)).drop(*[f"_of_{k}" for k in keys])


def joined_groups(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two summaries of the same groups side by side; null keys are keys."""
    b = b.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    return a.join(b, [a[k].eqNullSafe(F.col(f"_of_{k}")) for k in keys]).drop(*[f"_of_{k}" for k in keys])
