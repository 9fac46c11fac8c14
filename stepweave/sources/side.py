"""Parameters, time windows and exclusion lists."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_params(path: str) -> dict:
    """A JSON object: %x a string, #x a list of strings, @x a list of tuples of strings and lists of strings."""
    return json.loads(Path(path).read_text())


def check_params(params: dict) -> dict:
    def strings(x: object) -> bool:
        return isinstance(x, (list, tuple, set, frozenset)) and all(isinstance(v, str) for v in x)

    for name, value in params.items():
        kind = name[:1]
        if kind == "%" and not isinstance(value, (str, int)):
            raise ValueError(f"{name} has to be a string")
        if kind == "#" and not strings(value):
            raise ValueError(f"{name} has to be a list of strings")
        if kind == "@" and not (isinstance(value, (list, tuple)) and all(isinstance(t, (list, tuple)) and all(isinstance(v, str) or strings(v) for v in t) for t in value)):
            raise ValueError(f"{name} has to be a list of tuples of strings or lists of strings")
    return params


def _unique(df: DataFrame, what: str, *keys: str) -> DataFrame:
    again = df.groupBy(*keys).count().where("count > 1").take(1)
    if again:
        raise ValueError(f"{what}: {again[0][0]} is there twice")
    return df


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """_id, start, end and, if the lines have four columns, window_id, from CSV lines without a head."""
    width = len((spark.read.text(path).take(1) or [[""]])[0][0].split(","))
    schema = "_id string, start long, end long" + (", window_id string" if width > 3 else "")
    df = spark.read.schema(schema).option("mode", "FAILFAST").csv(path)
    df = df.withColumn("_id", F.lower(F.trim("_id")))
    return _unique(df, "windows", *(["window_id"] if width > 3 else ["_id"]))


def read_excludes(spark: SparkSession, path: str) -> DataFrame:
    """_id, one line each."""
    df = spark.read.text(path).select(F.lower(F.trim("value")).alias("_id")).where("_id <> ''")
    bad = df.where(~F.col("_id").rlike("^[0-9a-f]{32}$")).take(1)
    if bad:
        raise ValueError(f"not an id: {bad[0][0]}")
    return _unique(df, "excludes", "_id")
