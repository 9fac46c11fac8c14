"""One object, or with foreach a list with one object for each tuple, those without results included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.accumulate import Result
from ..operators.foreach import TUPLE


def json_rows(result: Result) -> DataFrame:
    """One column, json: a row for each object."""
    wide = result.wide()
    names = [c for c in wide.columns if c != TUPLE]
    return wide.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])).alias("json"))


def as_json(result: Result) -> dict | list[dict]:
    """On the driver: values that json.dumps takes, result variables before foreach variables."""
    wide = result.wide()
    rows = (wide.orderBy(TUPLE) if result.per_tuple else wide).collect()
    objects = [{k: sorted(v) if isinstance(v, (set, frozenset)) else v for k, v in r.asDict().items() if k != TUPLE} for r in rows]
    return objects if result.per_tuple else objects[0]
