"""Behavioural queries over event histories, lowered to Spark plans."""

from .dsl.ir import from_ir, to_ir
from .dsl.parser import parse
from .dsl.program import ParseError, Program
from .engine import plan_of, run
from .functions.registry import Functions
from .operators.accumulate import Result
from .sources import EventSource, histories_from_json, lexicon, read_excludes, read_params, read_windows

__all__ = ["EventSource", "Functions", "ParseError", "Program", "Result", "from_ir", "histories_from_json", "lexicon", "parse", "plan_of", "read_excludes", "read_params", "read_windows", "run", "to_ir"]
