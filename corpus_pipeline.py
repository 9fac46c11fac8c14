"""The corpus pipeline: language, boilerplate lines, near duplicates, benchmark passages, packing.

STAGES lists (name, function); each takes (spark, docs, sf_dir) and returns a
DataFrame which is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import _base
from stepweave.llm.decontaminate import decontaminate
from stepweave.llm.language_id import fit_profiles, keep_known
from stepweave.llm.line_dedup import line_dedup
from stepweave.llm.ngram_join import keep_one_of_each
from stepweave.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that resemble no language go. Profiles are fitted on the stage's own labelled rows.

    These are texts that are null or have no letters, and longer texts whose
    cosine with every language is what chance gives. Without labelled rows
    nothing is known of languages, and all texts with letters stay. Repeated
    rows go or stay together; other columns may have any name and stay.
    """
    return keep_known(docs, fit_profiles(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share stay where they stand first; n_chars, if there, follows the text.

    Every row stays. Null texts stay null; a text that loses all its lines is
    empty; rows that repeat a doc_id and text lose the same lines.
    """
    out = line_dedup(docs)
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of smallest doc_id.

    Texts that are null, empty or blank are in no group and stay. Of rows that
    repeat a doc_id and text with words one stays.
    """
    return keep_one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; rows of one text go or stay together; null and empty texts stay, and without a benchmark all do."""
    return decontaminate(docs, _base.table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, bin, start, n_tokens: every row is placed, repeated rows each, null and empty texts as one end mark."""
    return pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packing)]

#: SQL can't express hyperdimensional profiles, banding or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two is a table in the shared folder."""
    docs = _base.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = _base.new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
