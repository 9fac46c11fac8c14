"""What is taken out before matching: by event, by history, by time window, by overlap, by repetition.

The order is: event filter, excluded histories, time windows and overlap, then
events that are like their predecessor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.events import ID, SEQ, SOURCE, TS

KEY, START, END = "_key", "_start", "_end"


def event_filter(spec: dict, fields: list[str]) -> Column:
    """{"clauses": [[{"field", "value", "op": "equal" or "notequal"}]]}: all clauses, of each any term; a missing field is empty."""

    def term(t: dict) -> Column:
        op = t.get("op", "equal")
        if op not in ("equal", "notequal"):
            raise ValueError(f"No such comparison: {op}")
        equal = equals(F.col(f"`{t['field']}`") if t["field"] in fields else F.lit(""), t["value"])
        return equal if op == "equal" else ~equal

    clauses = spec["clauses"]
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, map(term, c), F.lit(False)) for c in clauses], F.lit(True))


def filter_fields(spec: dict | None) -> list[str]:
    return [t["field"] for c in (spec or {}).get("clauses", []) for t in c]


def equals(column: Column, value: str) -> Column:
    """Never null; null is the empty string. Simple comparisons reach the scan."""
    return F.coalesce(column, F.lit("")) == "" if value == "" else column.eqNullSafe(F.lit(value))


def exclude(events: DataFrame, ids: DataFrame) -> DataFrame:
    return events.join(ids.select(F.col(ids.columns[0]).alias(ID)).distinct(), ID, "left_anti")


def cut(events: DataFrame, windows: DataFrame | None, previous_end: list[int | None]) -> DataFrame:
    """Adds _key, _start and _end; keeps events with start <= ts < end, an end of 0 being open.

    previous_end has, for each source, the last time of the one before it: what
    lies earlier has been covered by that one. With windows, histories without
    one go; a window id takes the place of the history's id as the key.
    """
    low = F.lit(0).cast("long")
    for i, t in enumerate(previous_end):
        if t is not None:
            low = F.when(F.col(SOURCE) == i, F.lit(t)).otherwise(low)
    if windows is None:
        out = events.withColumns({KEY: F.col(ID), START: low, END: F.lit(0).cast("long")})
        return out.where(F.col(TS) >= F.col(START)) if any(t is not None for t in previous_end) else out
    named = "window_id" in windows.columns
    w = windows.select(F.col(windows.columns[0]).alias(ID), F.col("start").cast("long").alias("_from"), F.col("end").cast("long").alias(END), (F.col("window_id") if named else F.col(windows.columns[0])).cast("string").alias(KEY))
    out = events.join(w, ID).withColumn(START, F.greatest("_from", low)).drop("_from")
    return out.where((F.col(TS) >= F.col(START)) & ((F.col(END) == 0) | (F.col(TS) < F.col(END))))


def without_repeats(events: DataFrame, fields: list[str]) -> DataFrame:
    """Drops an event like the one before it in time and all fields."""
    before = Window.partitionBy(KEY, SOURCE).orderBy(TS, SEQ)
    alike = F.struct(F.col(TS), *[F.coalesce(F.col(f"`{f}`"), F.lit("")) for f in fields])
    return events.withColumn("_alike", alike).withColumn("_last", F.lag("_alike").over(before)).where(~F.col("_alike").eqNullSafe(F.col("_last"))).drop("_alike", "_last")
