"""The matcher as a stateful streaming operator.

A history's state (its machines, and the last event) is kept in the state
store by key. A history ends when no event has come for a while of event time:
a timer on the watermark then sends the closing event and drops the state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..dsl.program import Program
from ..engine import as_program
from ..operators import filters
from ..operators.foreach import make_tuples
from ..plans.machine import Machine, Matcher, Tuples
from ..plans.matching import TUPLES_PER_PASS
from ..sources.events import EventSource

RESULT = "tuple_idx long, var string, key array<string>, n long"


def match_stream(
    program: Program | str | dict,
    source: EventSource,
    idle_seconds: int,
    lateness: str = "0 seconds",
    params: dict | None = None,
    event_filter: dict | None = None,
    functions: dict[str, Callable[..., str]] | None = None,
    eager_outer_expiry: bool = False,
) -> DataFrame:
    """Additions to results, to be summed up by (tuple_idx, var, key); a null tuple_idx adds to all tuples.

    ``source`` is over a streaming table. A key's events have to come in order
    from batch to batch; inside a batch they are put in order. Events before
    the last one that was handled are left out. foreach takes a given array.
    Results are those of a batch run over the same histories, once a history
    has been idle for idle_seconds of event time.
    """
    program, params = as_program(program), params or {}
    if program.foreach and program.foreach.array is None:
        raise ValueError("a stream has no list of all values; give foreach an array")
    missing = [v for v in program.free if v not in params]
    if missing:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    own = program.fields
    judged = own if source.distinct else [*own, *(f for f in source.fields if f not in own)]
    wanted = list(dict.fromkeys([*judged, *filters.filter_fields(event_filter)]))
    events = source.rows(0, wanted)
    if event_filter:
        events = events.where(filters.event_filter(event_filter, wanted))
    tuples = make_tuples(source.df.sparkSession, program, [source], params)
    rows = None
    if tuples is not None:
        rows = tuples.block(0, 1)
        if len(rows) > TUPLES_PER_PASS:
            raise ValueError(f"{len(rows)} tuples; a stream takes {TUPLES_PER_PASS}")
    free = [frozenset(x for x in params[v] if x) if v[0] == "#" else params[v] for v in program.free]
    index = None if rows is None else Tuples(program, rows)
    calls, n_own, distinct = dict(functions or {}), len(own), source.distinct

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        matcher = Matcher(Machine(program, own, calls, eager_outer_expiry), free, index, not distinct, n_own)
        last = None
        if state.exists:
            raw, last = state.get
            matcher.resume(pickle.loads(raw))
        if state.hasTimedOut:
            matcher.close()
            state.remove()
        else:
            found = []
            for batch in batches:
                found += list(zip(batch["_ts"], batch["_seq"].map(_sortable), *[batch[f"f{i}"] for i in range(len(judged))]))
            for ts, _, *values in sorted(found):
                if last is None or ts >= last:
                    matcher.feed(key[0], 0, int(ts), 0, 0, tuple(values))
                    last = int(ts)
            state.update((pickle.dumps(matcher.save()), last))
            state.setTimeoutTimestamp(max((last + idle_seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        out = list(matcher.drain())
        yield pd.DataFrame({"tuple_idx": pd.array([r[0] for r in out], "Int64"), "var": [r[1] for r in out], "key": [list(r[2]) for r in out], "n": [r[3] for r in out]})

    flat = events.select(
        F.col("_id"), F.col("_ts"), F.to_json(F.struct("_seq")).alias("_seq"), F.timestamp_seconds("_ts").alias("_time"), *[F.coalesce(F.col(f"`{f}`"), F.lit("")).alias(f"f{i}") for i, f in enumerate(judged)]
    )
    return flat.withWatermark("_time", lateness).groupBy("_id").applyInPandasWithState(step, RESULT, "state binary, last long", "append", GroupStateTimeout.EventTimeTimeout)


def _sortable(seq: str) -> tuple:
    """Order columns as they were: numbers before texts."""
    import json

    value = json.loads(seq).get("_seq")
    parts = list(value.values()) if isinstance(value, dict) else [value]
    return tuple((isinstance(x, str), x if x is not None else 0) for x in parts)
