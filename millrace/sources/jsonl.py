"""JSON lines with the rules of each reader: S1-S8, S10."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import first_filled, py_strip

MESSAGES = "array<struct<role:string,content:string>>"
ROW = f"id string, prompt string, question string, instruction string, completion string, answer string, output string, response string, messages {MESSAGES}, labels array<int>"
PAIR = "prompt string, prompt_id string, chosen string, rejected string, score_chosen string, score_rejected string, chosen_score string, rejected_score string, chosen_rating string, rejected_rating string"
TRACE = f"request_id string, source string, source_id string, workload_class string, messages {MESSAGES}, prompt_tokens int, max_tokens int, arrival_offset_s double"


@F.pandas_udf(T.BooleanType())
def is_json_object(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether Python's strict reader takes a line for an object; the JVM's takes single quotes and trailing text."""

    def ok(line: str | None) -> bool:
        try:
            return line is not None and isinstance(json.loads(line), dict)
        except ValueError:
            return False

    for s in lines:
        yield pd.Series([ok(x) for x in s], dtype=bool)


def repaired(line: Column) -> Column:
    """Single quotes made double, commas at the end taken off."""
    return F.regexp_replace(F.translate(line, "'", '"'), ",+$", "")


def parsed(lines: DataFrame, line: str = "value", schema: str = ROW, repair: bool = True) -> DataFrame:
    """The non-blank lines with row (null if no object can be read) and valid. Without repair a bad line is just invalid.

    Nothing is dropped: count the invalid rows or leave them out, as the reader at hand does."""
    df = lines.withColumn("_l", py_strip(F.col(line))).where("_l <> ''").withColumn("_ok", is_json_object("_l"))
    if repair:
        df = df.withColumn("_r", F.when(F.col("_ok"), F.col("_l")).otherwise(repaired(F.col("_l")))).withColumn("valid", F.col("_ok") | is_json_object("_r"))
    else:
        df = df.withColumns({"_r": F.col("_l"), "valid": F.col("_ok")})
    return df.withColumn("row", F.when(F.col("valid"), F.from_json("_r", schema))).drop("_l", "_ok", "_r")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def sft_rows(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Rows of an instruction file, and how many lines can't be read even after repair. Nothing is cached: that is for the caller to decide."""
    df = parsed(read_lines(spark, path))
    bad = df.where("not valid").count()
    return df.where("valid").select("row.*"), bad


def pair_rows(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """S3: rows of a preference file, sides as message lists or text in JSON; no repair."""
    df = parsed(read_lines(spark, path), schema=PAIR, repair=False)
    return df.where("valid").select("row.*"), df.where("not valid").count()


def sides_of_json(df: DataFrame, names: tuple[str, ...] = ("chosen", "rejected")) -> DataFrame:
    """Sides that are JSON lists or plain text as message lists; plain text becomes one assistant message."""
    out = {}
    for n in names:
        listed = F.from_json(n, MESSAGES)
        out[n] = F.when(F.startswith(n, F.lit("[")) & F.exists(listed, lambda m: m["role"].isNotNull()), listed).otherwise(F.array(F.struct(F.lit("assistant").alias("role"), F.col(n).alias("content"))))
    return df.withColumns(out)


def parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    """A file that can't be read is an error, not an empty table."""
    return spark.read.parquet(path)


def head(df: DataFrame, order: str, n: int, columns: list[str]) -> DataFrame:
    """The first n rows by an order, with some columns."""
    return df.orderBy(order).limit(n).select(*columns)


def prompts(df: DataFrame, n: int, order: str | None = None) -> DataFrame:
    """Prompt of the first n rows that have one: the first message, else prompt, else instruction."""
    have = set(df.columns)
    first = [F.get("messages", F.lit(0))["content"]] if "messages" in have else []
    p = first_filled(*first, *[F.col(c) for c in ("prompt", "instruction") if c in have])
    out = df.withColumn("prompt", p).where("prompt <> ''")
    return (out.orderBy(order) if order else out).limit(n).select("prompt")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """S8."""
    return spark.read.schema(TRACE).json(path)


def write_trace(df: DataFrame, path: str) -> None:
    df.select(*[f.split(" ")[0] for f in TRACE.replace(MESSAGES, "m").split(", ")]).write.mode("overwrite").json(path)


def math_split(df: DataFrame, ordinal: str, skip: int, n: int | None = None, template: str = "Question: {q}\nAnswer:") -> DataFrame:
    """Prompt and target of question rows from the ordinal `skip` on, the first n of them. Ordinals count the file's lines, blank ones too. The target is what follows the last ####."""
    a, b = template.split("{q}")
    out = df.where(F.col(ordinal) >= skip).select(ordinal, F.concat(F.lit(a), "question", F.lit(b)).alias("prompt"), py_strip(F.element_at(F.split("answer", "####"), -1)).alias("target"))
    return out if n is None else out.orderBy(ordinal).limit(n)
