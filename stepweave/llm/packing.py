"""Conflict-constrained best-fit packing.

Documents are dealt at random to blocks of a bounded number of documents, and
each block is packed by itself: longest first, each piece into the bin with the
least room left that still holds it. Open bins are kept in order of their room;
each carries a bitmap of the sources and one of the duplicate clusters in it,
and the search goes on from bin to next larger bin until no bit is shared. So
no bin holds two documents of one source or of one duplicate cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base
from .ngram_join import near_duplicates

CAPACITY = 2048
DOCS_PER_BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def pack_block(pieces: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each (length, source bits, cluster bits), in the order given; longest pieces are placed first, ties in that order."""
    placed: list[tuple[int, int]] = [(0, 0)] * len(pieces)
    rooms: list[tuple[int, int]] = []  # (room left, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    for i in sorted(range(len(pieces)), key=lambda i: -pieces[i][0]):
        length, source, cluster = pieces[i]
        at = bisect_left(rooms, (length, -1))
        while at < len(rooms) and (sources[rooms[at][1]] & source or clusters[rooms[at][1]] & cluster):
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        placed[i] = b, capacity - room
        sources[b] |= source
        clusters[b] |= cluster
        if room > length:
            insort(rooms, (room - length, b))
    return placed


def _bits(keys: list) -> list[int]:
    """A bit for each key that occurs twice at least; others conflict with nothing, nor does None."""
    n = Counter(k for k in keys if k is not None)
    place = {k: p for p, k in enumerate(k for k in n if n[k] > 1)}
    return [1 << place[k] if k in place else 0 for k in keys]


def _pack_rows(rows: list[dict], capacity: int) -> Iterator[tuple]:
    rows.sort(key=lambda r: [(r[c] is None, r[c]) if r[c] is not None else (True,) for c in ("doc_id", "cluster", "source", "n_tokens")])
    source, cluster = _bits([r["source"] for r in rows]), _bits([r["cluster"] for r in rows])
    rest = [(i, r["n_tokens"] % capacity) for i, r in enumerate(rows) if r["n_tokens"] % capacity or not r["n_tokens"]]
    placed = pack_block([(n, source[i], cluster[i]) for i, n in rest], capacity)
    bins = max((b for b, _ in placed), default=-1) + 1
    for (i, n), (b, offset) in zip(rest, placed):
        yield rows[i]["doc_id"], rows[i]["n_tokens"] // capacity, b, offset, n
    for r in rows:  # full pieces fill a bin each
        for k in range(r["n_tokens"] // capacity):
            yield r["doc_id"], k, bins, 0, capacity
            bins += 1


def _with_classes(items: DataFrame, docs: DataFrame) -> DataFrame:
    """The class of near duplicates as cluster; texts without words, and classes without an id, keep theirs."""
    classes = near_duplicates(docs).where("n_copies > 0 and class_id is not null")
    named = classes.select(F.col("doc_id").alias("its_id"), F.col("text_key").alias("its_key"), F.col("class_id").cast("string").alias("class")).distinct()
    joined = items.join(named, items["doc_id"].cast("long").eqNullSafe(named["its_id"]) & (items["text_key"] == named["its_key"]), "left")
    return joined.withColumn("cluster", F.coalesce("class", "cluster")).drop("its_id", "its_key", "class")


def pack(docs: DataFrame, capacity: int = CAPACITY, docs_per_block: int = DOCS_PER_BLOCK, text: str = "text", source: str = "source", cluster: str | None = None, near_copies: bool = False) -> DataFrame:
    """Places every document in bins of ``capacity`` tokens.

    Tokens are words (runs of anything but ASCII white space) and one end mark
    for each document. Returns doc_id, piece, bin, start, n_tokens: a row for
    each piece, start being its place in the bin. A document longer than a bin
    fills bins of its own and its last piece is packed like a document. bin is
    unique over the table. ``cluster`` names a column of duplicate clusters;
    without one, documents with equal texts make a cluster, and with
    ``near_copies`` the classes of ``ngram_join.near_duplicates`` do.

    Null and empty texts have the end mark only and no cluster of their own.
    Null sources and clusters conflict with nothing. Repeated rows are copies,
    each placed. The block of a row follows from its values and its number among
    rows alike, so bins don't depend on how the table is laid out. doc_id may
    have any type (with ``near_copies``, long). An empty table gives an empty
    result; other columns are ignored.
    """
    _base.require(docs, "doc_id", text, source, *([cluster] if cluster else []))
    named = F.col(cluster).cast("string") if cluster else F.when(F.length(text) > 0, F.concat_ws("-", F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(5), text))))
    n_tokens = (F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)) + 1).cast("long")
    each = docs.select("doc_id", n_tokens.alias("n_tokens"), F.col(source).cast("string").alias("source"), named.alias("cluster"), F.xxhash64(text).alias("text_key"))
    # Rows that are all alike are counted before they are dealt.
    items = each.groupBy("doc_id", "n_tokens", "source", "cluster", "text_key").agg(F.count("*").alias("n"))
    if near_copies and not cluster:
        items = _with_classes(items, docs.select("doc_id", F.col(text).alias("text")))
    spark = docs.sparkSession
    n_blocks = max(1, -(-docs.count() // docs_per_block))
    columns = ["doc_id", "n_tokens", "source", "cluster"]
    placed = items.select(*columns, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    block = F.pmod(F.xxhash64(*columns, "copy"), F.lit(n_blocks))
    dealt = placed.select(*columns, block.alias("block")).repartition(max(1, min(n_blocks, _base.shuffle_partitions(spark))), "block").sortWithinPartitions("block")
    schema = docs.select("doc_id").schema.add("piece", "long").add("bin", "long").add("start", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def made(block: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for r in _pack_rows(rows, capacity):
                out.append(r)
                if len(out) == 50_000:
                    yield as_batch(block, out)
                    out = []
            yield as_batch(block, out)

        def as_batch(block: int, out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            bins = np.array(columns[2], np.int64) + (block << 32)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), pa.array(bins), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names=["doc_id", "piece", "bin", "start", "n_tokens"])

        current, held = None, []
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for r in batch.to_pylist():
                if r["block"] != current:
                    if held:
                        yield from made(current, held)
                    current, held = r["block"], []
                held.append(r)
        if held:
            yield from made(current, held)

    return dealt.mapInArrow(run, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, bin, start, n_tokens for every piece of every document."""
    return pack(_base.table(spark, sf_dir, "documents"), near_copies=True)
