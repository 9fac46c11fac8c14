"""Cases as JSON: {"tests": [{"desc", "trails", "expected", "filter"}], "params"}.

A program's text can carry them in comments below a line "-- unit tests --".
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from ..dsl.program import Program
from ..engine import as_program, run
from ..sinks.json_sink import as_json
from ..sources.events import histories_from_json

_HEAD = re.compile(r"^-+ *unit tests *-+ *$", re.M)


def embedded_cases(text: str) -> dict:
    """The cases in a program's comments; none if there is no such line."""
    m = _HEAD.search(text)
    if not m:
        return {"tests": []}
    body = "\n".join(re.sub(r"^-{2,}", "", line) for line in text[m.end() :].split("\n"))
    return json.loads(re.sub(r"-+\s*$", "", body))


def _same(got: object, want: object) -> bool:
    if isinstance(want, list):
        return isinstance(got, list) and sorted(map(str, got)) == sorted(map(str, want))
    return got == want


def _fits(got: dict, want: dict) -> bool:
    """Variables that the expectation doesn't name don't count."""
    return all(k in got and _same(got[k], v) for k, v in want.items())


def check_cases(spark: SparkSession, program: Program | str | dict, cases: dict | None = None, **options) -> list[str]:
    """What went wrong, one line for each case; empty if all hold. A list of expectations needs one result each."""
    if cases is None:
        cases = embedded_cases(program) if isinstance(program, str) else program
    program = as_program(program)
    failures = []
    for i, case in enumerate(cases["tests"]):
        params = cases.get("params", {}) | case.get("params", {})
        got = as_json(run(program, histories_from_json(spark, case["trails"]), params, case.get("filter"), **options))
        want = case["expected"]
        if isinstance(want, list):
            missing = [w for w in want if not any(_fits(g, w) for g in got)]
            ok = not missing and (case.get("partial", True) or len(got) == len(want))
        else:
            missing, ok = [want], _fits(got, want)
        if not ok:
            failures.append(f"{case.get('desc', f'case {i}')}: {missing} expected, got {got}")
    return failures
