"""Running a program over event sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dsl.ir import from_ir
from .dsl.parser import parse
from .dsl.program import Call, Program
from .functions.registry import Functions
from .operators import filters
from .operators.accumulate import Result
from .operators.foreach import make_tuples
from .plans import matching, stateless
from .sources.events import SOURCE, TS, EventSource, all_fields, union_sources
from .sources.side import check_params


def as_program(program: Program | str | dict) -> Program:
    """A parsed program, its text, or its JSON form."""
    return program if isinstance(program, Program) else from_ir(program) if isinstance(program, dict) else parse(program)


def prepare(program: Program, sources: list[EventSource], event_filter: dict | None, windows: DataFrame | None, excludes: DataFrame | None, drop_overlap: bool) -> tuple[DataFrame, list[str], bool]:
    """Events with keys and bounds after all filters but that of repetitions; their fields; whether none can repeat."""
    distinct = all(s.distinct for s in sources)
    there = all_fields(sources)
    wanted = dict.fromkeys([*program.fields, *filters.filter_fields(event_filter)])
    fields = [f for f in wanted if f in there] if distinct else there
    events = union_sources(sources, fields)
    # The end of a source is that of all its events, filtered or not.
    ends: list[int | None] = [None] * len(sources)
    if drop_overlap and len(sources) > 1:
        last = {r[0]: r[1] for r in union_sources(sources[:-1], []).groupBy(SOURCE).agg(F.max(TS)).collect()}
        ends = [None, *(last.get(i) for i in range(len(sources) - 1))]
    if event_filter:
        events = events.where(filters.event_filter(event_filter, fields))
    if excludes is not None:
        events = filters.exclude(events, excludes)
    return filters.cut(events, windows, ends), fields, distinct


def plan_of(program: Program) -> str:
    """stateless: joins and aggregations only; matcher: one ordered pass."""
    return "stateless" if stateless.applies(program) else "matcher"


def run(
    program: Program | str | dict,
    sources: EventSource | list[EventSource],
    params: dict | None = None,
    event_filter: dict | None = None,
    windows: DataFrame | None = None,
    excludes: DataFrame | None = None,
    functions: Functions | dict[str, Callable[..., str]] | None = None,
    drop_overlap: bool = True,
    eager_outer_expiry: bool = False,
    hll_input: str = "text",
    plan: str | None = None,
) -> Result:
    """Sets up the program's results over the sources, read in the order given.

    drop_overlap: events before the end of the source before are left out.
    eager_outer_expiry: an outer window ends what is in it at its time; without
    it, only once the block inside has run out or the history ends.
    hll_input: sketches hash a tuple's "text", items joined by commas, or its
    "encoded" form with a type for each item.
    plan: "matcher" keeps the general plan where another would do.

    Results are computed when they are asked for. Functions with hooks stay open
    until ``result.close()``, or use ``with run(...) as result``.
    """
    program = as_program(program)
    sources = [sources] if isinstance(sources, EventSource) else list(sources)
    params = check_params({k: v for k, v in (params or {}).items() if not isinstance(v, DataFrame)}) | {k: v for k, v in (params or {}).items() if isinstance(v, DataFrame)}
    functions = functions if isinstance(functions, Functions) else Functions(functions or {})
    for t in program.terms:
        if isinstance(t, Call):
            functions.check(t.name, len(t.args))
    missing = [v for v in program.free if v not in params]
    if missing:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    if hll_input not in ("text", "encoded"):
        raise ValueError(f"No such input of sketches: {hll_input}")
    encoded = hll_input == "encoded" and "hll" in program.results.values()
    functions.open()
    try:
        events, fields, distinct = prepare(program, sources, event_filter, windows, excludes, drop_overlap)
        tuples = make_tuples(events.sparkSession, program, sources, params)
        if not encoded and (plan or plan_of(program)) == "stateless":
            kept = events if distinct else filters.without_repeats(events, fields)
            return Result(program, tuples, stateless.match(kept, program, params, tuples, fields), functions.close)
        return Result(program, tuples, matching.match(events, program, params, tuples, dict(functions), fields, distinct, eager_outer_expiry, encoded), functions.close)
    except BaseException:
        functions.close()
        raise
