"""The tuples that foreach goes through."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsl.program import Program
from ..sources.events import EventSource, lexicon

TUPLE = "tuple_idx"


@dataclass(frozen=True)
class Tuples:
    """A table of tuple_idx and one column for each variable, by its name with the sigil."""

    df: DataFrame
    variables: tuple[str, ...]

    def block(self, k: int, n: int) -> list[tuple]:
        """The k-th of n parts, on the driver."""
        df = self.df if n == 1 else self.df.where(F.pmod(F.col(TUPLE), F.lit(n)) == k)
        return [(r[0], *(frozenset(v for v in x if v) if isinstance(x, list) else x for x in r[1:])) for r in df.select(TUPLE, *[f"`{v}`" for v in self.variables]).collect()]


def make_tuples(spark: SparkSession, program: Program, sources: list[EventSource], params: dict) -> Tuples | None:
    g = program.foreach
    if g is None:
        return None
    if g.array is None:
        name = next(f for f in program.variable_fields(g.variables[0]) if f != "timestamp")
        values = lexicon(sources, name)
        return Tuples(values.select(F.xxhash64("value").alias(TUPLE), F.col("value").alias(g.variables[0])), g.variables)
    if g.array not in params:
        raise ValueError(f"{g.array} is missing from the parameters")
    array = params[g.array]
    if isinstance(array, DataFrame):
        kinds = ", ".join(array.columns)
        if len(array.columns) != len(g.variables):
            raise ValueError(f"{g.array} has the columns {kinds}; foreach binds {len(g.variables)} variables")
        return Tuples(array.select(F.xxhash64(*array.columns).alias(TUPLE), *[_clean(c, v).alias(v) for c, v in zip(array.columns, g.variables)]), g.variables)
    rows = []
    for i, t in enumerate(array):
        if len(t) != len(g.variables):
            raise ValueError(f"{g.array}: tuple {i} has {len(t)} items; foreach binds {len(g.variables)} variables")
        for v, x in zip(g.variables, t):
            if isinstance(x, str) != (v[0] == "%"):
                raise ValueError(f"{g.array}: {v} of tuple {i} has to be {'a string' if v[0] == '%' else 'a list of strings'}")
        rows.append((i, *(x if isinstance(x, str) else list(x) for x in t)))
    schema = ", ".join([f"{TUPLE} long", *(f"`{v}` {'string' if v[0] == '%' else 'array<string>'}" for v in g.variables)])
    raw = spark.createDataFrame(rows, schema)
    return Tuples(raw, g.variables)


def _clean(column: str, variable: str):
    return F.col(f"`{column}`").cast("string" if variable[0] == "%" else "array<string>")
