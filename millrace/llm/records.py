"""Answers and records of the preference tables in one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<content:string,role:string>>"


def assistant_content(messages: Column) -> Column:
    """Content of the assistant message, wherever it stands in the list; several are joined by a line break, none gives null."""
    own = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda m: m["content"]), "\n"))


def chat_pairs(df: DataFrame) -> DataFrame:
    """row_id, source, prompt, chosen, rejected of a table whose sides are message lists."""
    return df.select("row_id", "source", "prompt", assistant_content(F.col("chosen")).alias("chosen"), assistant_content(F.col("rejected")).alias("rejected"))


def raw_pairs(df: DataFrame) -> DataFrame:
    """The same of JSON lines, whose sides are message lists or plain text. A line that is no JSON gives nulls."""
    sides = df.select(
        "row_id", "source", F.from_json("raw", "prompt string, chosen string, rejected string").alias("o")
    ).select("row_id", "source", "o.prompt", F.col("o.chosen").alias("c"), F.col("o.rejected").alias("r"))

    def side(text: Column) -> Column:
        listed = F.from_json(text, MESSAGES)
        return F.when(text.startswith("[") & F.exists(listed, lambda m: m["role"].isNotNull()), assistant_content(listed)).otherwise(text)

    return sides.select("row_id", "source", "prompt", side(F.col("c")).alias("chosen"), side(F.col("r")).alias("rejected"))


def all_pairs(completions: DataFrame, raw: DataFrame) -> DataFrame:
    return chat_pairs(completions).unionByName(raw_pairs(raw))
