"""Monitors of training and infrastructure: M1 to M13."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import bigrams, words
from millrace.operators.sequential import folded


def triad(df: DataFrame) -> DataFrame:
    """M1."""
    return df.withColumn("composite", F.col("format_reward") + F.col("accuracy_reward"))


def phase_changes(df: DataFrame, run: str, order: str, width: int = 5, drop: float = -0.15, gain: float = 0.03) -> DataFrame:
    """M2: adds changes of the last `width` rows' means against those before, in value and percent, and alert; null before 2 * width rows."""
    w = Window.partitionBy(run).orderBy(order)
    late, early = w.rowsBetween(1 - width, 0), w.rowsBetween(1 - 2 * width, -width)
    ready = F.row_number().over(w) >= 2 * width
    cols = {}
    for name, c in (("format", "format_reward"), ("accuracy", "accuracy_reward")):
        now, then = F.avg(c).over(late), F.avg(c).over(early)
        cols |= {f"{name}_delta": F.when(ready, now - then), f"{name}_pct": F.when(ready, (now - then) / (then + 1e-8) * 100)}
    df = df.withColumns(cols)
    return df.withColumn("alert", F.coalesce((F.col("format_delta") < drop) & (F.col("accuracy_delta") >= gain), F.lit(False)))


def diversity(df: DataFrame, group: str, completion: str, collapsed: float = 0.2) -> DataFrame:
    """M3: group, total, distinct2, ratio, collapsed: distinct word pairs of all pairs, which don't cross completions. Groups without pairs have ratio 0.

    Pairs are counted by (group, pair) with partial sums, so a large group is spread over its pairs."""
    pairs = df.select(F.col(group).alias("group"), F.explode_outer(bigrams(words(F.coalesce(completion, F.lit(""))))).alias("pair"))
    counts = pairs.groupBy("group", "pair").agg(F.count("pair").alias("n"))
    out = counts.groupBy("group").agg(F.sum("n").alias("total"), F.count_if(F.col("pair").isNotNull()).alias("distinct2"))
    ratio = F.coalesce(F.try_divide(F.col("distinct2"), F.col("total")), F.lit(0.0))
    return out.withColumn("ratio", ratio).withColumn("collapsed", F.col("ratio") < collapsed)


class Governor:
    """M4: counts collapsed steps; after enough of them raises the temperature until diversity is back or time is up. Recovery is looked for from the next step on."""

    def __init__(self, base: float = 0.7, hot: float = 1.15, bonus: float = 0.05, after: int = 5, duration: int = 150, recovered: float = 0.5, collapse: float = 0.2) -> None:
        self.base, self.hot, self.bonus, self.after, self.duration, self.recovered, self.collapse = base, hot, bonus, after, duration, recovered, collapse
        self.low, self.left, self.active = 0, 0, False

    def step(self, ratio: float | None) -> tuple[bool, float, float, int, str]:
        ratio = 0.0 if ratio is None else ratio
        self.low = self.low + 1 if ratio < self.collapse else 0
        action = "nominal"
        if self.active:
            self.left -= 1
            self.active = ratio < self.recovered and self.left > 0
            action = "annealing" if self.active else "recovered"
        elif self.low >= self.after:
            self.active, self.left, action = True, self.duration, "started"
        return self.active, self.hot if self.active else self.base, self.bonus if self.active else 0.0, self.low, action


def governed(df: DataFrame, run: str, order: str, ratio: str, **settings: float) -> DataFrame:
    """M4: run, order, active, temperature, bonus, low_steps, action for each row; runs are independent."""
    kind = dict(df.dtypes)
    return folded(df.select(run, order, ratio), [run], [order], lambda: Governor(**settings), lambda g, r: [(r[order], *g.step(r[ratio]))], f"{run} {kind[run]}, {order} {kind[order]}, active boolean, temperature double, bonus double, low_steps int, action string")


class Validation:
    """M5: the best accuracy that was accepted, and the steps since. An accuracy counts as better only if it beats the accepted best by the least gain."""

    def __init__(self, interval: int = 100, patience: int = 500, gain: float = 0.005) -> None:
        self.interval, self.patience, self.gain = interval, patience, gain
        self.best, self.stalled = 0.0, 0

    def step(self, step: int, accuracy: float) -> list[tuple]:
        if step % self.interval and step != 1:
            return []
        better = accuracy > self.best + self.gain
        if better:
            self.best, self.stalled = accuracy, 0
        else:
            self.stalled += self.interval
        return [(step, accuracy, better, not better and self.stalled >= self.patience)]


def validated(df: DataFrame, run: str, step: str, accuracy: str, **settings: float) -> DataFrame:
    """M5: run, step, accuracy, is_best, stop for the steps at which an evaluation is due."""
    kind = dict(df.dtypes)
    return folded(df.select(run, step, accuracy), [run], [step], lambda: Validation(**settings), lambda v, r: v.step(int(r[step]), float(r[accuracy])), f"{run} {kind[run]}, {step} int, accuracy double, is_best boolean, stop boolean")


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b <= 1e-8, 0.0).otherwise(2 * a * b / (a + b))


def pareto_classes(df: DataFrame, run: str, order: str, accuracy: str, form: str) -> DataFrame:
    """M6: adds f1 and best_accuracy, best_format, balanced: whether a row beats all before it strictly, from 0 on."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("f1", harmonic(F.col(accuracy), F.col(form)))
    beats = lambda c: F.col(c) > F.coalesce(F.greatest(F.max(c).over(w), F.lit(0.0)), F.lit(0.0))
    return df.withColumns({"best_accuracy": beats(accuracy), "best_format": beats(form), "balanced": beats("f1")})


def checkpoints(df: DataFrame, run: str, order: str, accuracy: str, form: str) -> DataFrame:
    """M6, M7: run, class, step: the checkpoint that each class ends with, the first to reach the best value. Classes without one have no row."""
    df = df.withColumn("f1", harmonic(F.col(accuracy), F.col(form)))
    key = lambda c: F.struct(F.col(c), -F.col(order))
    best = lambda c: F.when(F.max(c) > 0, F.max_by(order, key(c)))
    one = df.groupBy(run).agg(F.max(order).alias("latest"), best(accuracy).alias("best_accuracy"), best(form).alias("best_format"), best("f1").alias("balanced_pareto"))
    return one.unpivot([run], ["latest", "best_accuracy", "best_format", "balanced_pareto"], "class", "step").where("step is not null")


# The model of M8. Metrics that a device gives, in two tiers, and the long interval; scrapes a second that are slow and safe; latencies in ms; lock share in percent.
METRICS, FAST, SLOW, SLOW_S = 50, 6.0, 3.0, 15
BUSY, SAFE, CALM_MS, BUSY_MS, OVER_MS, LOCK_PCT = 5000, 40000, 45.0, 35, 305, 18.5


def scrape_contention(interval_ms: Column, tiered: Column, gpus: int = 800) -> Column:
    """M8: scrapes a second, lock share in percent, reduction in percent, p99 in ms, safe."""
    rate = F.when(tiered, gpus * (FAST / (interval_ms / 1000) + SLOW / SLOW_S)).otherwise(gpus * METRICS / (interval_ms / 1000))
    base = gpus * METRICS / 0.5
    p99 = F.when(rate >= SAFE, CALM_MS + OVER_MS * ((rate - SAFE) / SAFE)).when(rate > BUSY, CALM_MS + BUSY_MS * (rate / SAFE)).otherwise(CALM_MS)
    return F.struct(rate.alias("scrapes"), (LOCK_PCT * F.least(F.lit(1.0), rate / base)).alias("lock_pct"), (F.greatest(F.lit(0.0), 1 - rate / base) * 100).alias("reduction_pct"), p99.alias("p99_ms"), (rate < SAFE).alias("safe"))


# Codes that take a device out of service, the taint its node gets, and the pattern of their log lines.
FATAL = (31, 43, 45, 61, 62, 79, 92)
TAINT, NO_TAINT = "node.kubernetes.io/unschedulable:NoSchedule", "none"
LOG_LINE = r"NVRM:\s+Xid\s+\(PCI:([0-9a-fA-F:\.]+)\):\s+(\d+),\s+(.*)"


def log_faults(df: DataFrame, line: str) -> DataFrame:
    """Pci, code, reason, fatal, taint of the lines that report a device fault; works on streams too."""
    get = lambda k: F.regexp_extract(F.col(line), LOG_LINE, k)
    out = df.where(F.col(line).rlike(LOG_LINE)).withColumns({"pci": get(1), "code": F.expr("null").cast("int"), "reason": F.trim(get(3))}).withColumn("code", F.try_to_number(get(2), F.lit("999999")).cast("int"))
    fatal = F.coalesce(F.col("code").isin(*FATAL), F.lit(False))
    return out.withColumns({"fatal": fatal, "taint": F.when(fatal, TAINT).otherwise(NO_TAINT)})


# The metrics of a device that are kept in shared memory.
SHARED_METRICS = "DCGM_FI_DEV_FB_USED DCGM_FI_DEV_POWER_USAGE DCGM_FI_DEV_GPU_UTIL DCGM_FI_PROF_SM_ACTIVE DCGM_FI_PROF_SM_OCCUPANCY DCGM_FI_PROF_PIPE_TENSOR_ACTIVE DCGM_FI_DEV_GPU_TEMP DCGM_FI_DEV_FAN_SPEED DCGM_FI_DEV_PCIE_REPLAY_COUNTER".split()


def latest_metrics(samples: DataFrame, key: str) -> DataFrame:
    """For each key a map of each shared metric's newest value. samples: key, metric, ts, value."""
    newest = samples.where(F.col("metric").isin(*SHARED_METRICS)).groupBy(key, "metric").agg(F.max_by("value", "ts").alias("value"))
    return newest.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))


def sustained(df: DataFrame, keys: list[str], ts: str, value: str, limit: float, seconds: float, chunk_s: int = 86_400) -> DataFrame:
    """Keys, began, fired: spells in which a gauge stays above a limit for at least so long, on event time. Null values end a spell.

    Gaps and islands are found chunk by chunk of time, so that a key's rows never stand in one task; only spells, of which there are fewer, are put together over the chunks' borders."""
    rows = df.select(*keys, F.col(ts).alias("_t"), F.coalesce(F.col(value) > limit, F.lit(False)).alias("_over"), F.floor(F.unix_micros(ts) / 1e6 / chunk_s).alias("_c"))
    own = Window.partitionBy(*keys, "_c").orderBy("_t")
    marked = rows.withColumns({"_island": F.sum(F.when(F.col("_over"), 0).otherwise(1)).over(own), "_opens": F.row_number().over(own) == 1, "_closes": F.lead("_t").over(own).isNull()})
    spells = marked.where("_over").groupBy(*keys, "_c", "_island").agg(F.min("_t").alias("began"), F.max("_t").alias("_last"), F.bool_or("_opens").alias("_opens"), F.bool_or("_closes").alias("_closes"))
    by_key = Window.partitionBy(*keys)
    chunks = rows.select(*keys, "_c").distinct().withColumn("_before", F.lag("_c").over(by_key.orderBy("_c")))
    spells = spells.join(chunks, [*keys, "_c"])
    w = by_key.orderBy("began")
    goes_on = F.coalesce(F.col("_opens") & F.lag("_closes").over(w) & (F.lag("_c").over(w) == F.col("_before")), F.lit(False))
    whole = spells.withColumn("_on", goes_on).withColumn("_spell", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w))
    whole = whole.groupBy(*keys, "_spell").agg(F.min("began").alias("began"), F.max("_last").alias("_last"))
    age = F.unix_micros("_last") - F.unix_micros("began")
    return whole.where(age >= seconds * 1e6).select(*keys, "began", F.timestamp_micros(F.unix_micros("began") + F.lit(int(seconds * 1e6))).alias("fired"))


def counter_rates(df: DataFrame, keys: list[str], ts: str, value: str, window_s: int) -> DataFrame:
    """Keys, window start, rate per second of a counter within tumbling windows; falls count as restarts and add nothing, and so do null values."""
    # steps within a window are taken window by window, the step into it from the last value before, so that a key's rows never stand in one task
    start = F.timestamp_seconds(F.floor(F.unix_micros(ts) / 1e6 / window_s) * window_s)
    df = df.where(F.col(value).isNotNull()).withColumn("start", start)
    own = Window.partitionBy(*keys, "start").orderBy(ts)
    grown = df.withColumn("_up", F.greatest(F.col(value) - F.lag(value).over(own), F.lit(0.0)))
    by_window = grown.groupBy(*keys, "start").agg(F.sum("_up").alias("_up"), F.min_by(value, ts).alias("_first"), F.max_by(value, ts).alias("_last"))
    into = F.greatest(F.col("_first") - F.lag("_last").over(Window.partitionBy(*keys).orderBy("start")), F.lit(0.0))
    return by_window.select(*keys, "start", ((F.coalesce("_up", F.lit(0.0)) + F.coalesce(into, F.lit(0.0))) / window_s).alias("rate"))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float, upper: str = "le", count: str = "count") -> DataFrame:
    """Keys, value: quantile from cumulative bucket counts, linear within the first bucket that reaches the rank; the open bucket gives the last finite bound. No counts give null."""
    w = Window.partitionBy(*keys).orderBy(upper)
    total = F.max(count).over(Window.partitionBy(*keys))
    df = buckets.withColumns({"_rank": q * total, "_below": F.coalesce(F.lag(count).over(w), F.lit(0)), "_from": F.coalesce(F.lag(upper).over(w), F.lit(0.0))})
    hit = df.where((F.col(count) >= F.col("_rank")) & (F.col("_rank") > 0)).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    value = F.when(F.col(upper) == float("inf"), F.col("_from")).otherwise(F.col("_from") + (F.col(upper) - F.col("_from")) * F.try_divide(F.col("_rank") - F.col("_below"), F.col(count) - F.col("_below")))
    return hit.select(*keys, value.alias("value"))


class Scaler:
    """Replicas wanted for what waits, upwards at once, downwards after a time without need."""

    def __init__(self, per_replica: float = 5.0, least: int = 1, most: int = 3, cooldown_s: float = 300.0) -> None:
        self.per, self.least, self.most, self.cooldown = per_replica, least, most, cooldown_s
        self.now, self.since = least, None

    def step(self, at: float, waiting: float) -> int:
        want = min(self.most, max(self.least, -int(-waiting // self.per)))
        if want >= self.now:
            self.now, self.since = want, None
        else:
            self.since = at if self.since is None else self.since
            if at - self.since >= self.cooldown:
                self.now, self.since = want, None
        return self.now


def scaled(df: DataFrame, key: str, at: str, waiting: str, **settings: float) -> DataFrame:
    """Key, at, waiting, replicas. df has one row for each poll, its time in seconds."""
    kind = dict(df.dtypes)
    return folded(df.select(key, at, waiting), [key], [at], lambda: Scaler(**settings), lambda s, r: [(r[at], r[waiting], s.step(r[at], r[waiting]))], f"{key} {kind[key]}, {at} double, {waiting} double, replicas int")
