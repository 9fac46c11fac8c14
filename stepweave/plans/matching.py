"""The general plan: one shuffle by history, a sort inside partitions, and the matcher over Arrow batches.

A history is never gathered: events stream through in order and only the
machine's states are kept. Results are added up in the task before they are
shuffled by result value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dsl.program import Program
from ..operators.filters import END, KEY, START
from ..operators.foreach import Tuples
from ..sources.events import SEQ, SOURCE, TS
from .machine import Machine, Matcher
from .machine import Tuples as Index

RESULT = "tuple_idx long, var string, key array<string>, n long"
#: Tuples that one pass takes to the tasks; more are taken in several passes.
TUPLES_PER_PASS = 100_000
RESULTS_HELD = 100_000


def match(events: DataFrame, program: Program, params: dict, tuples: Tuples | None, functions: dict, fields: list[str], distinct: bool, eager_outer_expiry: bool, encoded_sketches: bool = False) -> DataFrame:
    """tuple_idx (null: of all tuples), var, key, n, partly added up; ``fields`` are all columns that repeated events are judged by."""
    own = program.fields
    others = [] if distinct else [f for f in fields if f not in own]
    columns = [KEY, SOURCE, TS, START, END, *own, *others]
    at_hand = [F.coalesce(F.col(f"`{f}`"), F.lit("")).alias(f"f{i}") if f in fields else F.lit("").alias(f"f{i}") for i, f in enumerate((*own, *others))]
    ordered = events.select(KEY, SOURCE, TS, SEQ, START, END, *at_hand).repartition(KEY).sortWithinPartitions(KEY, SOURCE, TS, SEQ).drop(SEQ)
    free = [frozenset(x for x in params[v] if x) if v[0] == "#" else params[v] for v in program.free]
    n_own = len(own)

    def passed(index: Index | None) -> DataFrame:
        machine = lambda: Machine(program, own, functions, eager_outer_expiry, encoded_sketches)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(machine(), free, index, not distinct, n_own)

            def results() -> pa.RecordBatch:
                rows = list(matcher.drain())
                return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([list(r[2]) for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.int64())], names=["tuple_idx", "var", "key", "n"])

            for batch in batches:
                key, source, ts, start, end, *values = [c.to_pylist() for c in batch.columns]
                events = zip(*values) if values else iter([()] * batch.num_rows)
                for k, s, t, a, b, e in zip(key, source, ts, start, end, events):
                    matcher.feed(k, s, t, a, b, e)
                if len(matcher.counts) > RESULTS_HELD:
                    yield results()
            matcher.close()
            yield results()

        return ordered.mapInArrow(run, RESULT)

    assert len(columns) == len(ordered.columns)
    if tuples is None:
        return passed(None)
    passes = max(1, -(-tuples.df.count() // TUPLES_PER_PASS))
    out = None
    for k in range(passes):
        rows = tuples.block(k, passes)
        if not rows:
            continue
        part = passed(Index(program, rows))
        if passes > 1:  # what all tuples share belongs to this pass's tuples
            ids = F.array(*[F.lit(r[0]) for r in rows])
            part = part.withColumn("tuple_idx", F.explode(F.when(F.col("tuple_idx").isNull(), ids).otherwise(F.array("tuple_idx"))))
        out = part if out is None else out.unionByName(part)
    return ordered.sparkSession.createDataFrame([], RESULT) if out is None else out
