"""Preflight of instruction data: P1 to P20."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.stats import ks_p_value, ks_statistic, percentiles
from millrace.functions.text import first_filled, normal_key, py_strip, tokens_quarter
from millrace.functions.tokens import TEMPLATE, UnknownTokenizer, chat_lengths
from millrace.session import stored

IGNORED = -100


def _of_role(messages: Column, role: str) -> Column:
    return py_strip(F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: F.coalesce(m["content"], F.lit(""))), "\n"))


def extracted(df: DataFrame) -> DataFrame:
    """Adds p, c, valid, error to rows of any of messages, prompt/question/instruction, completion/answer/output/response.

    A list of messages comes first, if it isn't null. A row without prompt text is invalid. Columns that the table lacks count as null."""
    have = set(df.columns)
    keyed = lambda names: first_filled(*[F.col(n) for n in names if n in have])
    p, c = py_strip(keyed(["prompt", "question", "instruction"])), py_strip(keyed(["completion", "answer", "output", "response"]))
    if "messages" in have:
        listed = F.col("messages").isNotNull()
        p, c = F.when(listed, _of_role(F.col("messages"), "user")).otherwise(p), F.when(listed, _of_role(F.col("messages"), "assistant")).otherwise(c)
        error = F.when(listed, "Missing user prompt in messages").otherwise("Empty or missing prompt")
    else:
        error = F.lit("Empty or missing prompt")
    return df.withColumns({"p": p, "c": c}).withColumns({"valid": F.col("p") != "", "error": F.when(F.col("p") == "", error)})


def featurised(rows: DataFrame, max_len: int = 1024, tokens: str = "char4", template: tuple[str, str] = TEMPLATE) -> DataFrame:
    """P2-P4 as lengths: adds prompt_len, answer_len, target_len, raw_len, total_len, empty, truncated to rows of P1, and boundary_ok where tokens are counted.

    tokens is char4, an estimate by characters, or a tokenizer's file, which counts the templated texts; any other name is refused with UnknownTokenizer (P15), so that no estimate passes for a count. By char4 an empty answer has no tokens.
    Right truncation keeps the first max_len; an answer is truncated if some of its tokens were lost."""
    if tokens == "char4":
        prompt, target = tokens_quarter(F.col("p")), F.when(F.col("c") == "", 0).otherwise(tokens_quarter(F.col("c")))
        df = rows.withColumns({"prompt_len": prompt, "answer_len": target}).withColumn("raw_len", F.col("prompt_len") + F.col("answer_len"))
    else:
        df = rows.withColumn("_lengths", chat_lengths(F.col("p"), F.col("c"), tokens, template)).select("*", "_lengths.*").drop("_lengths").withColumn("answer_len", F.col("raw_len") - F.col("prompt_len"))
    total = F.least(F.col("raw_len"), F.lit(max_len))
    df = df.withColumns({"total_len": total, "target_len": F.greatest(total - F.col("prompt_len"), F.lit(0)), "empty": F.col("c") == ""})
    return df.withColumn("truncated", (F.col("raw_len") > max_len) & (F.col("target_len") < F.col("answer_len")))


def right_truncated(ids: Column, max_len: int) -> Column:
    """P3 on token ids."""
    return F.slice(ids, 1, max_len)


def answer_labels(ids: Column, prompt_len: Column) -> Column:
    """-100 for the prompt's places, else the id."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_len, F.lit(IGNORED)).otherwise(x))


def misaligned(labels: Column, prompt_len: Column, empty: Column) -> Column:
    """P5: labels that teach the prompt, mask nothing, or mask a whole answer. Null or empty labels are no fault."""
    head, tail = F.slice(labels, 1, F.greatest(prompt_len, F.lit(0))), F.filter(labels, lambda x, i: i >= prompt_len)
    taught = F.exists(F.when(prompt_len > 0, head).otherwise(F.array().cast("array<int>")), lambda x: x != IGNORED)
    return F.coalesce((F.size(labels) > 0) & (taught | ~F.array_contains(labels, IGNORED) | (~empty & (F.size(tail) > 0) & F.forall(tail, lambda x: x == IGNORED))), F.lit(False))


def collated(df: DataFrame, batch: str, ids: str, labels: str, pad_id: int = 0) -> DataFrame:
    """Adds padded ids, mask and labels up to the batch's longest row, and useful and padded counts of the batch."""
    over = Window.partitionBy(batch)
    n, most = F.size(ids), F.max(F.size(ids)).over(over)
    fill = lambda value: F.array_repeat(F.lit(value), most - n)
    return df.withColumns({"padded_ids": F.concat(F.col(ids), fill(pad_id)), "mask": F.concat(F.array_repeat(F.lit(1), n), fill(0)), "padded_labels": F.concat(F.col(labels), fill(IGNORED)), "useful": F.sum(n).over(over), "padded": most * F.count(F.lit(1)).over(over)})


def padding_waste(df: DataFrame, length: str, ordinal: str, batch_size: int) -> DataFrame:
    """Useful, padded, waste_pct of batches in the order of ordinal, which must be 0, 1, 2, ... without gaps."""
    batches = df.groupBy(F.floor(F.col(ordinal) / batch_size).alias("b")).agg(F.max(length).alias("m"), F.count(F.lit(1)).alias("n"), F.sum(length).alias("u"))
    total = batches.agg(F.coalesce(F.sum("u"), F.lit(0)).alias("useful"), F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).alias("padded"))
    return total.withColumn("waste_pct", F.coalesce(F.try_divide(F.col("padded") - F.col("useful"), F.col("padded")) * 100, F.lit(0.0)))


def dense_ordinal(df: DataFrame, order_by: str, name: str = "ordinal") -> DataFrame:
    """0, 1, 2, ... in the order of a column, by a range sort: parts are numbered by themselves and shifted by the parts before them.

    The numbered parts are written once and read twice: ranges come from a sample and would differ if they were made again. Ties get different numbers, in no stated order."""
    parts = df.repartitionByRange(order_by).sortWithinPartitions(order_by).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    parts = stored(parts, "ordinal")
    base = parts.groupBy("_part").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    # one row for each part
    before = base.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") - F.col("_low") + F.col("_before")).drop("_part", "_at", "_low", "_n", "_before")


def length_stats(df: DataFrame) -> DataFrame:
    """P10: one row of statistics of total_len over valid rows, empty answers included."""
    x = F.col("total_len")
    p95, p99 = percentiles(x, [0.95, 0.99])
    return df.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.try_divide(F.stddev_pop(x), F.avg(x)).alias("cv"), F.min(x).cast("int").alias("shortest"), F.max(x).cast("int").alias("longest"),
        p95.alias("p95"), p99.alias("p99"), F.avg("prompt_len").alias("avg_prompt"), F.avg("target_len").alias("avg_target"),
    )


def anomaly_counts(df: DataFrame, max_len: int = 1024) -> DataFrame:
    """One row of counts over all rows of featurised(): total, invalid, empty, else truncated, over-long, misaligned, valid, duplicate prompts.

    Empty and truncated exclude each other, the rest is counted for itself. Duplicates are valid rows beyond the distinct prompts."""
    ok = F.col("valid")
    wrong = F.col("misaligned") if "misaligned" in df.columns else F.lit(False)
    key = F.when(ok, F.col("prompt_key") if "prompt_key" in df.columns else normal_key(F.col("p")))
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~ok).alias("invalid"), F.count_if(ok & F.col("empty")).alias("empty"), F.count_if(ok & ~F.col("empty") & F.col("truncated")).alias("truncated"),
        F.count_if(ok & (F.col("raw_len") > max_len)).alias("over_length"), F.count_if(ok & wrong).alias("misaligned"), F.count_if(ok & ~F.col("empty")).alias("valid"), (F.count_if(ok) - F.count_distinct(key)).alias("duplicates"),
    )


def gate(counts: DataFrame) -> DataFrame:
    """Adds gate, and the list of what stands behind it."""
    bad = [F.when(F.col(c) > 0, F.lit(c)) for c in ("invalid", "empty", "truncated", "misaligned")]
    advice = [F.when(F.col(c) > 0, F.lit(c)) for c in ("duplicates", "over_length")]
    kept = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return counts.withColumns({"warnings": kept(bad + advice), "gate": F.when(F.size(kept(bad)) > 0, "Validation Alerts Detected").when(F.size(kept(advice)) > 0, "Optimization Advisories").otherwise("Clean Execution")})


def report(df: DataFrame, max_len: int = 1024, batch_size: int = 4, invalid_json: int = 0, tokens: str = "char4") -> DataFrame:
    """The whole preflight report as one row. An empty table gives zeros and a clean gate with no lengths. Where the tokenizer isn't there nothing is looked at: zeros, and a gate that says so."""
    try:
        rows = featurised(extracted(df), max_len, tokens)
    except UnknownTokenizer:
        none = report(df.where(F.lit(False)), max_len, batch_size)
        zeros = {c: F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in none.dtypes if c not in ("warnings", "gate")}
        return none.withColumns(zeros | {"warnings": F.array(F.lit("tokenizer")), "gate": F.lit("Unable to Inspect")})
    # texts are read once; three aggregates then read lengths, flags and a 128 bit key of each prompt
    rows = stored(rows.select("ordinal", "valid", "empty", "truncated", "raw_len", "total_len", "prompt_len", "target_len", F.unhex(F.md5(normal_key(F.col("p")))).alias("prompt_key")), "features")
    ok = rows.where("valid")
    counts = anomaly_counts(rows, max_len).withColumns({"total": F.col("total") + invalid_json, "invalid": F.col("invalid") + invalid_json})
    waste = padding_waste(dense_ordinal(ok.select("ordinal", "total_len").withColumnRenamed("ordinal", "o"), "o", "ordinal"), "total_len", "ordinal", batch_size)
    return gate(counts).withColumn("one", F.lit(1)).join(length_stats(ok).withColumn("one", F.lit(1)), "one").join(waste.withColumn("one", F.lit(1)), "one").drop("one")


# Own words for what a report finds: (what, severity, text). P14.
ADVICE = [
    ("invalid", "error", "rows can't be read or have no prompt: repair or remove them"),
    ("empty", "error", "rows have an empty answer, whose loss is undefined: remove them"),
    ("truncated", "warning", "answers lose tokens to the length limit: raise it or leave out long prompts"),
    ("misaligned", "error", "rows teach their prompt or mask their answer: label answers only"),
    ("duplicates", "advice", "prompts came before: keep one of each"),
    ("over_length", "advice", "rows are over the length limit: choose how to cut them"),
]
PADDED, DRIFTED = 20.0, 0.05


def advice(found: DataFrame, p_value: float | None = None) -> DataFrame:
    """Kind, severity, n, share_pct (of all rows), text for what a report's row shows: each count above 0, padding above PADDED percent of all places, and lengths that drifted from an earlier data set's, if their p-value is given and below DRIFTED."""
    share = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("total")), F.lit(0.0))
    line = lambda kind, severity, n, pct, text: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), n.cast("long").alias("n"), pct.alias("share_pct"), F.lit(text).alias("text"))
    lines = [F.when(F.col(kind) > 0, line(kind, severity, F.col(kind), share(kind), text)) for kind, severity, text in ADVICE]
    lines.append(F.when(F.col("waste_pct") > PADDED, line("padding", "advice", F.col("padded") - F.col("useful"), F.col("waste_pct"), "of all places are padding: batch rows of like length, or pack them")))
    lines.append(F.when(F.lit(p_value is not None and p_value < DRIFTED), line("drift", "warning", F.lit(None), F.lit(p_value).cast("double"), "lengths are not distributed as before: set batch sizes anew")))
    return found.select(F.explode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("x")).select("x.*")


def drift(lengths: DataFrame, before: DataFrame) -> tuple[float, float]:
    """Distance of two columns `v` and its p-value; no values on a side give 0 and 1."""
    r = ks_statistic(lengths, before).first()
    return float(r["d"] or 0.0), ks_p_value(r["d"], r["n"] or 0, r["m"] or 0)


def passes_strict(report_row: dict) -> bool:
    """Whether a report lets a strict run go on."""
    return report_row["gate"] == "Clean Execution" and not report_row["warnings"]


def batch_faults(df: DataFrame, ids: str = "ids", labels: str = "labels", prompt_len: str = "prompt_len", used: str = "used", eos: int = 2, start: int = 1) -> DataFrame:
    """Adds fault, the first failed check of a row, else null, and counts of taught places.

    used is the length without padding; start is the id that must open a row."""
    x, y, p, n = F.col(ids), F.col(labels), F.col(prompt_len), F.col(used)
    taught = F.filter(y, lambda v: v != IGNORED)
    causal = F.filter(y, lambda v, i: (v != IGNORED) & (i >= 1))
    in_prompt, in_pad = F.filter(y, lambda v, i: (i < p) & (v != IGNORED)), F.filter(y, lambda v, i: (i >= n) & (v != IGNORED))
    other = F.exists(F.zip_with(x, y, lambda a, b: (b != IGNORED) & (a != b)), lambda v: v)
    fault = (
        F.when(F.size(taught) == 0, "nothing supervised").when(F.size(causal) == 0, "nothing supervised after the first place").when(F.size(in_prompt) > 0, "prompt supervised").when(F.size(in_pad) > 0, "padding supervised")
        .when(other, "label differs from token").when(F.get(x, F.lit(0)) != start, "delimiter missing").when(F.forall(taught, lambda v: v == eos), "only the end supervised")
    )
    return df.withColumns({"fault": fault, "taught": F.size(taught), "causal": F.size(causal), "prompt_taught": F.size(in_prompt), "pad_taught": F.size(in_pad), "sample": F.slice(x, 1, 25)})


def reconciled(actual: DataFrame, approved: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """Key, verdict: whether the ids that reached training are the approved ones, or those without the last. Rows of one side only are missing."""
    a, b = actual.select(key, F.col(ids).alias("a")), approved.select(key, F.col(ids).alias("b"))
    one_less = F.slice(F.col("b"), 1, F.greatest(F.size("b") - 1, F.lit(0)))
    verdict = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "same").when(F.col("a") == one_less, "without last").otherwise("different")
    return a.join(b, key, "full").select(key, verdict.alias("verdict"))


def scoreboard(cases: DataFrame) -> DataFrame:
    """P20: detector, right, cases: a verdict is right if a clean case is accepted or a faulty one blocked. cases: detector, faulty, blocked."""
    return cases.groupBy("detector").agg(F.count_if(F.col("faulty") == F.col("blocked")).alias("right"), F.count(F.lit(1)).alias("cases"))
