"""The plan for one block: filters, a join with the tuples, aggregation; no Python.

Each event takes its first matching clause. For foreach, every clause that
looks at a variable must compare one and the same field with it, so that only
events joined with a tuple on that value can differ from the rest: the rest's
results count for all tuples and are taken back for the joined ones.

Without foreach, clauses may also quit: a history's events after its first such
event are left out by a minimum over the history.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dsl.program import Clause, Condition, Field, Literal, Param, Program, Yield
from ..functions.hll import slot
from ..operators.filters import END, KEY, START, equals
from ..operators.foreach import TUPLE, Tuples
from ..sources.events import SEQ, SOURCE, TS

_HASH_FIELD = "_hll"


def anchor(program: Program) -> Condition | None:
    """A comparison with a foreach variable that all clauses with any such comparison have."""
    clauses = [c for c in program.blocks[0].clauses if _uses(c, program)]
    for c in clauses[0].conditions if clauses else ():
        if isinstance(c.operand, Param) and c.operand.name in program.bound and c.field != "timestamp" and all(any((x.field, x.op, x.operand) == (c.field, c.op, c.operand) for x in other.conditions) for other in clauses):
            return c
    return None


def _uses(c: Clause, program: Program) -> bool:
    return any(isinstance(x.operand, Param) and x.operand.name in program.bound for x in c.conditions)


def applies(program: Program) -> bool:
    if len(program.blocks) != 1 or program.entry:
        return False
    b = program.blocks[0]
    plain = all(isinstance(t, Field | Literal) for y in program.yields for t in y.terms)
    quits = any(c.move.kind == "quit" for c in b.clauses)
    if quits and (program.foreach or not any(not c.conditions and not c.negated for c in b.clauses)):
        return False
    if b.is_window or any(c.move.kind not in ("repeat", "quit") for c in b.clauses) or not all(isinstance(t, Field | Literal) for c in b.clauses for y in c.yields for t in y.terms):
        return False
    if not plain and any(b.after.yields):
        return False
    foreach = [c for c in b.clauses if _uses(c, program)]
    return not foreach or (anchor(program) is not None and not any(c.negated for c in foreach))


def match(events: DataFrame, program: Program, params: dict, tuples: Tuples | None, fields: list[str]) -> DataFrame:
    """tuple_idx (null: of all tuples), var, key, n, not yet added up. A timeout of the only block can never fire."""
    clauses = program.blocks[0].clauses
    value = lambda name: F.lit(params[name]) if name[0] == "%" else F.array(*[F.lit(x) for x in params[name] if x]).cast("array<string>")
    column = lambda f: F.col(f"`{f}`") if f in fields else F.lit("")

    def results(df: DataFrame, index: Column, sign: int, bound: Callable[[str], Column | None], only: list[int]) -> DataFrame:
        """The yields of the clause that each row takes; ``only`` are the clauses of interest."""
        tests = [_test(c, column, lambda name: bound(name) if name in program.bound else value(name)) for c in clauses]
        taken = reduce(lambda rest, i: F.when(tests[i], i).otherwise(rest), range(len(tests) - 1, -1, -1), _none_matches(program, clauses))
        yielding = [i for i in only if clauses[i].yields]
        quitting = [i for i in only if clauses[i].move.kind == "quit"]
        if not yielding:
            return None
        wanted = reduce(lambda a, b: a | b, [tests[i] for i in {*yielding, *quitting}])
        exhaustive = any(not c.conditions and not c.negated for c in clauses)
        rows = df.where(wanted) if exhaustive else df  # reaches the scan; the taken clause decides
        rows = rows.withColumn("_clause", taken).where(F.col("_clause").isin([*yielding, *quitting]))
        if quitting:
            place = F.struct(SOURCE, TS, SEQ)
            last = F.min(F.when(F.col("_clause").isin(quitting), place)).over(Window.partitionBy(KEY))
            rows = rows.withColumn("_last", last).where((F.col("_last").isNull() | (place <= F.col("_last"))) & F.col("_clause").isin(yielding))
        made = reduce(lambda rest, i: F.when(F.col("_clause") == i, _made(clauses[i].yields, column)).otherwise(rest), yielding, F.lit(None))
        return rows.select(index.alias("tuple_idx"), F.explode(made).alias("y")).select("tuple_idx", "y.var", "y.key", F.lit(sign).cast("long").alias("n"))

    every = list(range(len(clauses)))
    nothing = F.lit(None).cast("long")
    shared = results(events, nothing, 1, lambda name: None, every)
    parts = [shared] if shared is not None else []
    at = anchor(program) if tuples is not None else None
    if at is not None:
        side = tuples.df.select(F.col(TUPLE), *[F.col(f"`{v}`").alias(f"_v{i}") for i, v in enumerate(tuples.variables)])
        places = {v: F.col(f"_v{i}") for i, v in enumerate(tuples.variables)}
        own = places[at.operand.name]
        keyed = side.withColumn("_value", F.explode(F.array_distinct(own)) if at.op == "in" else own)
        if at.op == "in":
            keyed = keyed.where("_value <> ''")
        joined = events.withColumn("_value", F.coalesce(column(at.field), F.lit(""))).join(keyed, "_value")
        using = [i for i in every if _uses(clauses[i], program)]
        # A joined event differs from the rest only if it takes a clause that looks at the tuple.
        changed = joined.where(reduce(lambda a, b: a | b, [_test(clauses[i], column, lambda name: places.get(name) if name in places else value(name)) for i in using]))
        mine = results(changed, F.col(TUPLE), 1, places.get, every)
        back = results(changed, F.col(TUPLE), -1, lambda name: None, [i for i in every if i not in using])
        parts += [x for x in (mine, back) if x is not None]
    if not parts:
        return events.sparkSession.createDataFrame([], "tuple_idx long, var string, key array<string>, n long")
    out = reduce(DataFrame.unionByName, parts)
    sketches = [v for v, kind in program.results.items() if kind == "hll"]
    if not sketches:
        return out
    plain, hashed = out.where(~F.col("var").isin(sketches)), out.where(F.col("var").isin(sketches))
    register = F.udf(lambda text: [str(x) for x in slot(text)], "array<string>", useArrow=True)
    # Values are hashed once they are distinct; a register's ranks are added up like values.
    once = hashed.groupBy("tuple_idx", "var", "key").agg(F.sum("n").alias("n"))
    return plain.unionByName(once.select("tuple_idx", "var", register(F.array_join("key", ",")).alias("key"), "n"))


def _none_matches(program: Program, clauses: tuple[Clause, ...]) -> Column:
    return F.raise_error(F.concat(F.lit(f"No clause of {program.blocks[0].name} matches an event at "), F.col(TS).cast("string"), F.lit(" of "), F.col(KEY))).cast("int")


def _test(clause: Clause, column: Callable[[str], Column], bound: Callable[[str], Column | None]) -> Column:
    test = reduce(lambda a, b: a & b, [_condition(c, column, bound) for c in clause.conditions], F.lit(True))
    return ~test if clause.negated else test


def _condition(c: Condition, column: Callable[[str], Column], bound: Callable[[str], Column | None]) -> Column:
    value = bound(c.operand.name) if isinstance(c.operand, Param) else None
    if isinstance(c.operand, Param) and value is None:
        return F.lit(False)  # a variable of a tuple that isn't in this event
    if c.field == "timestamp":
        x = F.col(TS)
        y = F.lit(c.operand) if value is None else value.cast("long")
        return {"=": x == y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[c.op]
    x = column(c.field)
    if value is None:
        return equals(x, c.operand)
    x = F.coalesce(x, F.lit(""))
    return (x != "") & F.array_contains(value, x) if c.op == "in" else x == value


def _made(yields: tuple[Yield, ...], column: Callable[[str], Column]) -> Column:
    return F.array(*[F.struct(F.lit(y.target).alias("var"), (F.array(*[_term(t, column) for t in y.terms]) if y.terms else F.array().cast("array<string>")).alias("key")) for y in yields])


def _term(t: Field | Literal, column: Callable[[str], Column]) -> Column:
    if isinstance(t, Literal):
        return F.lit(str(t.value))
    special = {"cookie": KEY, "timestamp": TS, "cookie_timestamp_filter_start": START, "cookie_timestamp_filter_end": END}
    return F.col(special[t.name]).cast("string") if t.name in special else F.coalesce(column(t.name), F.lit(""))
