"""python -m stepweave PROGRAM SOURCE... : runs a program over Parquet tables and prints its results."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .dsl.ir import to_ir
from .engine import as_program, plan_of, run
from .sinks.diagram import to_dot
from .sinks.formats import write_result
from .sources.events import EventSource
from .sources.side import read_excludes, read_params, read_windows
from .testing import check_cases, embedded_cases


def load_program(path: str) -> str | dict:
    """A program's text, or its JSON form from a file that ends in .json."""
    text = Path(path).read_text()
    return json.loads(text) if path.endswith(".json") else text


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="stepweave", description=__doc__)
    a.add_argument("program")
    a.add_argument("sources", nargs="*", help="Parquet tables, read one after the other")
    a.add_argument("--id", default="id", help="column of the history's id")
    a.add_argument("--ts", default="ts", help="column of the time in seconds")
    a.add_argument("--order", default="", help="columns that order events of equal time, comma-separated")
    a.add_argument("--fields", default="", help="columns of event fields, comma-separated; all others by default")
    a.add_argument("--distinct", action="store_true", help="no two neighbouring events are alike")
    a.add_argument("--params")
    a.add_argument("--filter", help="a JSON file with clauses")
    a.add_argument("--window-file")
    a.add_argument("--exclude-file")
    a.add_argument("--output-format", choices=("json", "msgpack", "proto"), default="json")
    a.add_argument("--proto", help="the .proto file that defines Result")
    a.add_argument("--keep-overlap", action="store_true")
    a.add_argument("--eager-outer-expiry", action="store_true")
    a.add_argument("--show", choices=("json", "diagram", "plan"), help="the program's JSON form, its diagram or its plan, without running it")
    a.add_argument("--test", action="store_true", help="runs the cases in the program's comments")
    o = a.parse_args(argv)
    source = load_program(o.program)
    program = as_program(source)
    if o.show:
        print({"json": lambda p: json.dumps(to_ir(p), indent=1), "diagram": to_dot, "plan": plan_of}[o.show](program))
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if o.test:
        failures = check_cases(spark, program, embedded_cases(source) if isinstance(source, str) else source)
        print("\n".join(failures) or "all cases hold")
        return int(bool(failures))
    if not o.sources:
        a.error("a source is needed")
    split = lambda text: [x for x in text.split(",") if x]
    sources = []
    for path in o.sources:
        df = spark.read.parquet(path)
        names = split(o.fields) or [c for c in df.columns if c not in (o.id, o.ts, *split(o.order))]
        sources.append(EventSource(df, o.id, o.ts, {n: f"`{n}`" for n in names if n in df.columns}, tuple(split(o.order)), o.distinct))
    result = run(
        program,
        sources,
        read_params(o.params) if o.params else {},
        json.loads(Path(o.filter).read_text()) if o.filter else None,
        read_windows(spark, o.window_file) if o.window_file else None,
        read_excludes(spark, o.exclude_file) if o.exclude_file else None,
        drop_overlap=not o.keep_overlap,
        eager_outer_expiry=o.eager_outer_expiry,
    )
    sys.stdout.buffer.write(write_result(result, o.output_format, Path(o.proto).read_text() if o.proto else None))
    sys.stdout.flush()
    return 0


if __name__ == "__main__":
    sys.exit(main())
