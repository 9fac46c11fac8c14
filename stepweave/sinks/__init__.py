"""Results as JSON, MessagePack and Protocol Buffers; histories as JSON and tables; a diagram of the machine."""

from .formats import write_result
from .histories import extract_histories, histories_json, history_rows
from .json_sink import as_json, json_rows

__all__ = ["as_json", "extract_histories", "histories_json", "history_rows", "json_rows", "write_result"]
