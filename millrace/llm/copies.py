"""Problem 1: records that are equal but for spacing, case, punctuation and the order of fields and messages.

Method: canonical form (letters and digits only, one case), a 128 bit hash over the fields in fixed order, counts by
map-side combined aggregation, a second independent hash as collision check.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.joins import with_hot_keys
from millrace.session import cut


_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x30, 0x7B) if chr(c).isalnum())
_NARROW = "".join(chr(c) for c in range(0x30, 0x7B) if chr(c).isalnum())


@F.pandas_udf(T.StringType())
def _composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore").astype(object)


def composed(text: Column) -> Column:
    """Text whose letters and marks are one character where there is such a one, so that both ways to write an accented letter are the same. Only texts that hold marks leave the JVM."""
    return F.coalesce(_composed(F.when(text.rlike(r"\p{M}"), text)), text)


def canonical(text: Column) -> Column:
    """Letters and digits of a text in one case and width; a sharp s is its capitals' two letters, an accented letter is itself (not its plain one). Null gives ''."""
    letters = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", ""), _WIDE, _NARROW)
    return F.replace(F.lower(F.upper(letters)), F.lit("ß"), F.lit("ss"))


def keyed(df: DataFrame, id_col: str, fields: list[str], keep: list[str] = ()) -> DataFrame:
    """id, key (128 bit), check (64 bit of another hash) and kept columns. Fields are taken in the given order, whatever their order in the source."""
    whole = reduce(lambda a, b: F.concat(a, F.lit("|"), b), [canonical(composed(F.col(f))) for f in fields])
    return df.select(F.col(id_col).alias("id"), *keep, whole.alias("whole")).select("id", *keep, F.unhex(F.md5("whole")).alias("key"), F.xxhash64("whole", F.length("whole")).alias("check"))


def copy_groups(keys: DataFrame) -> DataFrame:
    """One row for each group: key, check, record_id (smallest id), copies (records in it), collided (the same key also came with another check; the groups stay apart).

    Partial sums are made before the shuffle, so a group with a third of all rows sends one row for each task. Ids that repeat count as often as they stand there."""
    by_both = keys.groupBy("key", "check").agg(F.min("id").alias("record_id"), F.count(F.lit(1)).alias("copies"))
    return by_both.withColumn("collided", F.count(F.lit(1)).over(Window.partitionBy("key")) > 1)


def copy_members(keys: DataFrame) -> DataFrame:
    """record_id, copy_id: each record that isn't the first of its group, with the first.

    Hot groups, of which there are at most 1000 by their definition, are joined by broadcast; all others by a shuffle join of rows of 36 bytes. Empty input gives no rows; a null id is no record."""
    keys = cut(keys.where("id is not null").select("id", "key", "check"))
    groups = keys.groupBy("key", "check").agg(F.min("id").alias("record_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    return with_hot_keys(keys, groups, ["key", "check"]).where("id <> record_id").select("record_id", F.col("id").alias("copy_id")).distinct()
