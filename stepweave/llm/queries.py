"""The queries of this subpackage and, where SQL can express one, the SQL for its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op6_decontamination
from .language_id import op2_language_id
from .line_dedup import op8_line_dedup
from .media import op10_media
from .ngram_join import op9_ngram_join
from .oracles import ORACLE_SQL
from .packing import op3_packing
from .secrets import op1_secret_scan
from .sharding import op4_sharding
from .substring_dedup import op5_substring_dedup
from .token_files import op7_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_token_files": op7_token_files,
    "op8_line_dedup": op8_line_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_media": op10_media,
}

__all__ = ["ORACLE_SQL", "QUERIES"]

