"""Joins of rows, among which one key may hold a third, with tables of one row for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of all rows is hot; so there are at most 1/HOT_SHARE hot keys, few enough to broadcast.
HOT_SHARE = 0.001
#: Below so many rows a key is no burden.
LEAST_HOT = 10_000


def with_hot_keys(rows: DataFrame, unique: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join. Rows of hot keys, at most 1000 by their definition, meet their one row by broadcast where they lie; all others by shuffle. rows is read three times, so it should be a table or a checkpoint. Null keys meet nothing."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bound = max(float(LEAST_HOT), HOT_SHARE * rows.count())
    hot = counts.where(F.col("_n") >= bound).select(*keys)
    if hot.isEmpty():
        return rows.join(unique, keys)
    hot_rows = rows.join(F.broadcast(unique.join(F.broadcast(hot), keys, "left_semi")), keys)
    return hot_rows.unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(unique, keys))
