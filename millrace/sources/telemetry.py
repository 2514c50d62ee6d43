"""Metrics text, device samples, kernel logs, configurations and reports: S13-S18."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"[-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+|Inf|NaN)"
_SAMPLE = rf"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{{(.*)\}})?\s+({_NUMBER})"
SAMPLES = "ts string, pstate string, temperature double, power double, utilisation double, memory_utilisation double, memory_used double, sm_clock double, memory_clock double"


def metrics(lines: DataFrame, line: str = "value") -> DataFrame:
    """The input's other columns with metric, labels (map), number of each sample line; comments and other lines are left out."""
    get = lambda k: F.regexp_extract(F.col(line), _SAMPLE, k)
    pairs = F.transform(F.regexp_extract_all(get(2), F.lit(r'[a-zA-Z_][a-zA-Z0-9_]*="[^"]*"'), F.lit(0)), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_extract(p, '"(.*)"', 1).alias("value")))
    number = F.when(get(3).endswith("Inf"), F.when(get(3).startswith("-"), float("-inf")).otherwise(float("inf"))).when(get(3) == "NaN", float("nan")).otherwise(F.expr("null").cast("double"))
    out = lines.where(F.col(line).rlike(_SAMPLE))
    return out.select(*[c for c in lines.columns if c != line], get(1).alias("metric"), F.map_from_entries(pairs).alias("labels"), F.coalesce(number, get(3).try_cast("double")).alias("number"))


def device_samples(spark: SparkSession, path: str) -> DataFrame:
    """Nine columns of a sampler's lines; "[Not Supported]" is null, and lines with fewer columns are left out."""
    raw = spark.read.text(path).withColumn("f", F.transform(F.split("value", ","), lambda x: F.trim(x))).where(F.size("f") >= 9)
    names = [x.split(" ") for x in SAMPLES.split(", ")]
    text = lambda k: F.nullif(F.col("f")[k], F.lit("[Not Supported]"))
    return raw.select(*[(text(k) if t == "string" else F.regexp_extract(text(k), r"^[-+]?\d+\.?\d*", 0).try_cast("double")).alias(n) for k, (n, t) in enumerate(names)])


def config(spark: SparkSession, path: str) -> DataFrame:
    """A JSON or flat YAML file as one row; values keep their JSON types. A configuration is small and read on the driver."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        values = {}
        for line in text.splitlines():
            name, colon, value = line.split("#")[0].partition(":")
            if colon and name.strip() and value.strip():
                try:
                    values[name.strip()] = json.loads(value.strip().lower() if value.strip() in ("True", "False") else value.strip())
                except ValueError:
                    values[name.strip()] = value.strip().strip("'\"")
    else:
        values = json.loads(text)
    return spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.createDataFrame([()], "")


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def markdown_rows(df: DataFrame, name: str, pairs: list[tuple[str, str]], digits: int = 2) -> DataFrame:
    """Line: a table row for each record with `mean ± deviation` cells."""
    cells = [F.format_string(f"%.{digits}f ± %.{digits}f", F.col(m).cast("double"), F.col(s).cast("double")) for m, s in pairs]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", F.col(name).cast("string"), *cells), F.lit(" |")).alias("line"))
