"""Testing programs: cases kept with a program's text, and cases generated from patterns."""

from .cases import check_cases, embedded_cases
from .scenarios import parse_scenarios

__all__ = ["check_cases", "embedded_cases", "parse_scenarios"]
