"""Contiguous shards of equal bytes by global prefix sums.

Rows are put in order of doc_id over the partitions. Per-partition totals,
summed over the partitions before, and a running sum inside each partition give
every row the number of bytes before it in the whole table; equal targets cut
that into shards. Only ids, sizes and checksums are moved, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _base

SHARDS = 8


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one more; null has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _placed(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, size, text_crc32, part, bytes_before, row: row and bytes before it over the whole table, in order of doc_id."""
    spark = docs.sparkSession
    order = ["doc_id", "text_crc32", "size"]
    rows = docs.select(F.col("doc_id"), text_size(F.col(text)).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    # Written once: the ranges are cut by a sample, so every later read must see the same partitions.
    ranged = _base.checkpoint(rows.repartitionByRange(_base.shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # One row for each partition, however many rows there are.
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("bytes").over(up_to), F.lit(0)).alias("part_bytes"), F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("part_rows"))
    inside = Window.partitionBy("part").orderBy(*order)
    local = ranged.withColumns({"own_bytes": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "own_rows": F.row_number().over(inside) - 1})
    return local.join(before, "part").select(*order, (F.col("part_bytes") + F.col("own_bytes")).alias("bytes_before"), (F.col("part_rows") + F.col("own_rows")).alias("row"))


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row: shards are contiguous in doc_id and of near equal bytes.

    A row belongs to the shard in whose share of all bytes the row's middle
    lies, so a shard is off its target by less than its first and last rows.
    slot counts the rows of a shard from 0. Rows go by doc_id, null first, then
    by checksum and size; rows alike in all three are interchangeable. Null and
    empty texts have size 1. A table with fewer rows than shards leaves some
    shards empty, an empty one all. Other columns are ignored.
    """
    _base.require(docs, "doc_id", text)
    placed = _base.checkpoint(_placed(docs, text))
    total = placed.agg(F.sum("size")).first()[0] or 1
    middle = F.col("bytes_before") * 2 + F.col("size")
    cut = placed.withColumn("shard", F.least(F.floor(middle.cast("decimal(38,0)") * shards / (2 * total)), F.lit(shards - 1)).cast("int"))
    begins = {r["shard"]: r["row"] for r in cut.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    first = F.lit(0)
    for shard, row in begins.items():
        first = F.when(F.col("shard") == shard, row).otherwise(first)
    return cut.select("doc_id", "size", "text_crc32", "shard", (F.col("row") - first).cast("long").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard, by the law of bytes."""
    out = shard_by_bytes(_base.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
