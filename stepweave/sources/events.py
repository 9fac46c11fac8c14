"""Tables of events as histories.

A source names the column of a history's id, the event time in whole seconds,
the columns that order events of equal time, and the event fields. Several
sources are read one after the other; a field that one of them lacks is empty
there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ID, TS, SOURCE, SEQ = "_id", "_ts", "_source", "_seq"


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class EventSource:
    """``distinct`` declares that no two neighbouring events are alike in time and all fields, so that none need be looked for."""

    df: DataFrame
    id: str | Column
    ts: str | Column
    fields: dict[str, str | Column]
    order: tuple[str | Column, ...] = field(default=())
    distinct: bool = False

    def rows(self, ord: int, fields: list[str]) -> DataFrame:
        """_id, _source, _ts, _seq and the fields as strings; null stays null and means empty."""
        seq = F.struct(*[_column(c).alias(f"k{i}") for i, c in enumerate(self.order)]) if self.order else F.lit(0)
        own = [_column(self.fields[f]).cast("string").alias(f) if f in self.fields else F.lit(None).cast("string").alias(f) for f in fields]
        return self.df.select(_column(self.id).cast("string").alias(ID), F.lit(ord).alias(SOURCE), _column(self.ts).cast("long").alias(TS), seq.alias(SEQ), *own)


def union_sources(sources: list[EventSource], fields: list[str]) -> DataFrame:
    parts = [s.rows(i, fields) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def all_fields(sources: list[EventSource]) -> list[str]:
    return list(dict.fromkeys(f for s in sources for f in s.fields))


def lexicon(sources: list[EventSource], name: str) -> DataFrame:
    """The distinct values of a field over all sources, and the empty one: one column, value."""
    if not any(name in s.fields for s in sources):
        raise ValueError(f"No source has the field {name}")
    values = union_sources([s for s in sources if name in s.fields], [name]).select(F.col(name).alias("value"))
    empty = sources[0].df.sparkSession.range(1).select(F.lit("").alias("value"))
    return values.where(F.length("value") > 0).unionByName(empty).distinct()


def padded_id(text: str) -> str:
    """Lower-case hex of a name filled up with zero bytes to 16."""
    raw = text.encode()
    if len(raw) > 16:
        raise ValueError(f"{text} is longer than 16 bytes")
    return raw.ljust(16, b"\0").hex()


def histories_from_json(spark: SparkSession, trails: list[dict]) -> list[EventSource]:
    """Sources from [{name: [{"timestamp": int, field: value}]}], one for each element; raises where time goes back."""
    sources = []
    for part in trails:
        names = sorted({k for events in part.values() for e in events for k in e if k != "timestamp"})
        rows = []
        for name, events in part.items():
            last = None
            for i, e in enumerate(events):
                if last is not None and e["timestamp"] < last:
                    raise ValueError(f"{name}: time goes back from {last} to {e['timestamp']}")
                last = e["timestamp"]
                rows.append((padded_id(name), i, last, *(e.get(n, "") for n in names)))
        schema = ", ".join(["id string", "seq long", "ts long", *(f"`{n}` string" for n in names)])
        sources.append(EventSource(spark.createDataFrame(rows, schema), "id", "ts", {n: F.col(f"`{n}`") for n in names}, ("seq",)))
    return sources
