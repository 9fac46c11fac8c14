"""Results: partial counts of all plans added up, and the forms they are returned in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dsl.program import Param, Program
from ..functions import hll
from .foreach import TUPLE, Tuples


def shared_yields(program: Program) -> bool:
    """Whether a machine for which no variable ever matches can yield anything."""
    seen, todo = set(), [program.inner(program.entry)]
    while todo:
        i = todo.pop()
        if i in seen:
            continue
        seen.add(i)
        b = program.blocks[i]
        edges = [c for c in b.clauses if c.negated or not any(isinstance(x.operand, Param) and x.operand.name in program.bound for x in c.conditions)]
        for e in (*edges, b.after, *(program.blocks[w].after for w in b.windows)):
            if e.yields:
                return True
            if e.move.block is not None:
                todo.append(program.inner(e.move.block))
    return False


@dataclass(frozen=True)
class Result:
    program: Program
    tuples: Tuples | None
    partial: DataFrame
    #: What is to be done after the last action, such as the functions' ``finalize``.
    close: Callable[[], None] = lambda: None

    def __enter__(self) -> Result:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @property
    def per_tuple(self) -> bool:
        return self.tuples is not None and not self.program.foreach.merged

    @cached_property
    def _counts(self) -> DataFrame:
        """tuple_idx, var, key, n with n > 0."""
        once = self.partial.groupBy(TUPLE, "var", "key").agg(F.sum("n").alias("n"))
        if self.tuples is None:
            return once
        own = once.where(F.col(TUPLE).isNotNull())
        common = once.where(F.col(TUPLE).isNull())
        if not self.per_tuple:
            if shared_yields(self.program):
                own = own.unionByName(common.withColumn("n", F.col("n") * self.tuples.df.count()))
            return own.groupBy("var", "key").agg(F.sum("n").alias("n")).where("n > 0").select(F.lit(None).cast("long").alias(TUPLE), "var", "key", "n")
        if shared_yields(self.program):  # each of these is a result of every tuple
            spread = common.drop(TUPLE).crossJoin(self.tuples.df.select(TUPLE)).select(TUPLE, "var", "key", "n")
            own = own.unionByName(spread).groupBy(TUPLE, "var", "key").agg(F.sum("n").alias("n"))
        return own.where("n > 0")

    def long(self) -> DataFrame:
        """tuple_idx, var, kind, key, n: a row for each result value; of a sketch, key is the register and n its rank."""
        kinds = F.create_map(*[x for v, k in self.program.results.items() for x in (F.lit(v), F.lit(k))]) if self.program.results else F.create_map().cast("map<string,string>")
        rows = self._counts.withColumn("kind", kinds[F.col("var")])
        plain = rows.where("kind <> 'hll'").select(TUPLE, "var", "kind", "key", F.when(F.col("kind") == "set", 1).otherwise(F.col("n")).cast("long").alias("n"))
        if "hll" not in self.program.results.values():
            return plain
        ranks = rows.where("kind = 'hll'").groupBy(TUPLE, "var", "kind", F.slice("key", 1, 1).alias("key")).agg(F.max(F.col("key")[1].cast("long")).alias("n"))
        return plain.unionByName(ranks.select(TUPLE, "var", "kind", "key", "n"))

    def wide(self) -> DataFrame:
        """One row for each tuple, or one row: result variables, then foreach variables; all are there, even without results."""
        results = self.program.results
        spark = self.partial.sparkSession
        rows = self.long()
        of = [_gathered(v, k).alias(v) for v, k in results.items()]
        if not self.per_tuple:
            out = rows.agg(*of) if of else spark.range(1).select()
        else:
            grouped = rows.groupBy(TUPLE).agg(*of) if of else spark.createDataFrame([], f"{TUPLE} long")
            out = self.tuples.df.join(grouped, TUPLE, "left")
        columns = [F.coalesce(F.col(f"`{v}`"), _none(k)).alias(v) for v, k in results.items()]
        names = [*results, *(self.tuples.variables if self.per_tuple else ())]
        keep = [TUPLE] if self.per_tuple else []
        made = out.select(*keep, *columns, *[F.col(f"`{v}`") for v in names[len(results) :]])
        sketches = [v for v, k in results.items() if k == "hll"]
        if sketches:
            encode = F.udf(lambda m: hll.to_hex({int(r["at"]): r["rank"] for r in m}), "string", useArrow=True)
            for v in sketches:
                made = made.withColumn(v, encode(F.col(f"`{v}`")))
        return made

    def table(self, variable: str) -> DataFrame:
        """The values of one result variable: foreach variables, then value (an array of strings) and n; a counter has n only, 0 where nothing was counted."""
        rows = self.long().where(F.col("var") == variable)
        kind = self.program.results[variable]
        if not self.per_tuple:
            return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")) if kind == "counter" else rows.select(F.col("key").alias("value"), "n")
        if kind == "counter":
            return self.tuples.df.join(rows.select(TUPLE, "n"), TUPLE, "left").select(*[F.col(f"`{v}`") for v in self.tuples.variables], F.coalesce("n", F.lit(0)).alias("n"))
        return self.tuples.df.join(rows, TUPLE).select(*[F.col(f"`{v}`") for v in self.tuples.variables], F.col("key").alias("value"), "n")


def _gathered(variable: str, kind: str) -> Column:
    """An aggregate over the long rows of one tuple."""
    mine = F.col("var") == variable
    text = F.array_join("key", ",")
    if kind == "counter":
        return F.sum(F.when(mine, F.col("n")))
    if kind == "set":
        return F.array_sort(F.collect_set(F.when(mine, text)))
    if kind == "multiset":
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(mine, F.struct(text.alias("value"), F.col("n"))))))
    return F.collect_list(F.when(mine, F.struct(F.col("key")[0].alias("at"), F.col("n").alias("rank"))))


def _none(kind: str) -> Column:
    return {
        "counter": F.lit(0).cast("long"),
        "set": F.array().cast("array<string>"),
        "multiset": F.create_map().cast("map<string,bigint>"),
        "hll": F.array().cast("array<struct<at:string,rank:bigint>>"),
    }[kind]
