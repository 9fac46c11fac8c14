"""Event histories and the side tables of a run."""

from .events import EventSource, histories_from_json, lexicon, union_sources
from .side import read_excludes, read_params, read_windows

__all__ = ["EventSource", "histories_from_json", "lexicon", "read_excludes", "read_params", "read_windows", "union_sources"]
