"""Histories taken out of sources: as rows, as a new table, as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import event_filter
from ..sources.events import ID, SEQ, SOURCE, TS, EventSource, all_fields, union_sources


def _chosen(sources: list[EventSource], ids: DataFrame | list[str] | None, filter: dict | None) -> tuple[DataFrame, list[str]]:
    fields = all_fields(sources)
    events = union_sources(sources, fields)
    if filter:
        events = events.where(event_filter(filter, fields))
    if isinstance(ids, DataFrame):
        events = events.join(ids.select(F.col(ids.columns[0]).alias(ID)).distinct(), ID, "left_semi")
    elif ids is not None:
        events = events.where(F.col(ID).isin(list(ids)))
    return events, fields


def extract_histories(sources: list[EventSource], ids: DataFrame | list[str] | None = None, filter: dict | None = None) -> DataFrame:
    """id, source, ts and the union of all fields, empty where a source lacks one; write it to make a new source."""
    events, fields = _chosen(sources, ids, filter)
    return events.select(F.col(ID).alias("id"), F.col(SOURCE).alias("source"), F.col(TS).alias("ts"), F.col(SEQ).alias("seq"), *[F.coalesce(F.col(f"`{f}`"), F.lit("")).alias(f) for f in fields])


def history_rows(sources: list[EventSource], ids: DataFrame | list[str] | None = None, filter: dict | None = None) -> DataFrame:
    """source, id, events: each history's events of one source as an ordered array of JSON objects."""
    events, fields = _chosen(sources, ids, filter)
    own = F.to_json(F.struct(F.col(TS).alias("timestamp"), *[F.coalesce(F.col(f"`{f}`"), F.lit("")).alias(f) for f in fields]))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(TS, SEQ, own.alias("event")))), lambda x: x["event"])
    return events.groupBy(F.col(SOURCE).alias("source"), F.col(ID).alias("id")).agg(ordered.alias("events"))


def histories_json(sources: list[EventSource], ids: DataFrame | list[str] | None = None, filter: dict | None = None) -> DataFrame:
    """source, json: one {id: [events]} for each history."""
    rows = history_rows(sources, ids, filter)
    return rows.select("source", F.concat(F.lit("{"), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(":["), F.array_join("events", ","), F.lit("]}")).alias("json"))
