"""Programs over unbounded event streams."""

from .matching import match_stream

__all__ = ["match_stream"]
