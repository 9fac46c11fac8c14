"""Benchmark decontamination by spaced-seed hashing.

Fixed masks say which tokens of a window count and which are ignored. The
hashes of all windows of the benchmark under each mask are a table of seeds,
and so are those of every document; the two are joined on the hash. Every seed
brings the tokens around it, as many as a passage through it can have, so a hit
is verified where it is found, token by token. The masks are derived from the
number of tokens of a passage and of those that may be substituted, so that
wherever these are, one mask lies in the passage and ignores them all: no
passage is without a hit.

A Bloom filter of the benchmark's hashes, of bounded size, goes to the tasks
and keeps the documents' other seeds out of the join. Only what can hit is
shuffled, never a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base, _words

OVERLAP = 13
IDENTITY = 0.8
#: Seeds of the benchmark that are broadcast at most (some 250 bytes each); more are shuffled.
BROADCAST_SEEDS = 200_000
#: Parts of each hash's rows in that shuffle.
SALTS = 16
#: The Bloom filter has 2 to the power of this many bits at most.
MOST_BITS = 27
CHUNK_CHARS = 1_500_000
#: Masks for one number of tokens; as many tokens count in each as this number allows.
MOST_MASKS = 5
#: Longer passages are halved, as the placements to cover grow too many.
MOST_PLACED = 13


def substitutions(n: int, identity: float) -> int:
    """How many of n tokens may differ."""
    if not 0 < identity <= 1:
        raise ValueError(f"identity is over 0 and 1 at most, not {identity}")
    return n - next(equal for equal in range(1, n + 1) if equal >= identity * n)


def _cover(n: int, differ: int, weight: int) -> tuple[str, ...] | None:
    """MOST_MASKS masks at most, of so many tokens that count, one of which fits beside any ``differ`` of n tokens; greedily."""
    placements = [sum(1 << i for i in at) for at in combinations(range(n), differ)]
    free: dict[str, int] = {}
    for ones in combinations(range(n), weight):
        if ones[0] == 0:
            mask = sum(1 << i for i in ones)
            shifted = [mask << k for k in range(n - ones[-1])]
            free["".join("01"[i in ones] for i in range(ones[-1] + 1))] = sum(1 << k for k, p in enumerate(placements) if any(m & p == 0 for m in shifted))
    left, chosen = (1 << len(placements)) - 1, []
    while left and len(chosen) < MOST_MASKS:
        best = max(free, key=lambda m: ((free[m] & left).bit_count(), -len(m), m))
        left &= ~free[best]
        chosen.append(best)
    return None if left else tuple(chosen)


@cache
def masks_for(n: int, differ: int) -> tuple[str, ...]:
    """Masks of which one at least meets only equal tokens, wherever ``differ`` of n tokens or fewer are substituted.

    1: the token counts; 0: it is ignored.
    """
    if n > MOST_PLACED:  # one half has half of the substitutions at most
        return masks_for(n // 2, differ // 2)
    found = (_cover(n, differ, weight) for weight in range(n - differ, 0, -1))
    return next((masks for masks in found if masks), ("1",))


MASKS = masks_for(OVERLAP, substitutions(OVERLAP, IDENTITY))

_alnum: dict[str, np.ndarray] = {}


def _is_token() -> np.ndarray:
    if "is" not in _alnum:
        _alnum["is"] = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _alnum["is"]


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of letters and digits in lower case, and where each text's begin."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(lower) + "\n").encode("utf-32-le"), np.uint32)
    inside = _is_token()[points]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    lead = np.cumsum([0] + [len(t) + 1 for t in lower])
    return _words.segment_hashes(points, start, end), np.searchsorted(start, lead)


def _seeds(words: np.ndarray, at: np.ndarray, mask: str) -> np.ndarray:
    value = np.full(len(at), int("1" + mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            value = (value ^ words[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
    return _words.mix(value)


def _around(words: np.ndarray, first: np.ndarray, at: np.ndarray, owner: np.ndarray, reach: int, outside: int) -> np.ndarray:
    """Seeds x (2 * reach + 1) tokens, the seed's first in the middle; ``outside`` stands for what isn't in the text."""
    place = at[:, None] + np.arange(-reach, reach + 1)
    inside = (place >= first[owner][:, None]) & (place < first[owner + 1][:, None])
    found = words[np.clip(place, 0, max(0, len(words) - 1))] if len(words) else np.zeros(place.shape, np.uint64)
    # Tokens have a bit that what is outside hasn't.
    return np.where(inside, found | np.uint64(2), np.uint64(outside))


_OUTSIDE = {"item": 0, "document": 1}


def wanted_masks(lengths: set[int], overlap: int, identity: float, masks: tuple[str, ...] | None) -> dict[str, list[int]]:
    """The masks for passages of these lengths, and the lengths that each is for."""
    wanted: dict[str, list[int]] = {}
    for n in sorted(lengths):
        for mask in masks if masks and n == overlap else masks_for(n, substitutions(n, identity)):
            wanted.setdefault(mask, []).append(n)
    return wanted


def item_seeds(texts: list[str], overlap: int, identity: float, masks: tuple[str, ...] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, item, tokens of a passage and tokens around, for all seeds; items shorter than a passage are looked for whole, with masks for their own length."""
    words, first = tokens(texts)
    passage = np.minimum(np.diff(first), overlap)
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2 * overlap - 1), np.uint64))]
    for mask, lengths in wanted_masks(set(passage.tolist()) - {0}, overlap, identity, masks).items():
        at, item = _words.windows(first, len(mask))
        chosen = np.isin(passage[item], lengths)
        at, item = at[chosen], item[chosen]
        found.append((_seeds(words, at, mask), item, passage[item], _around(words, first, at, item, overlap - 1, _OUTSIDE["item"])))
    return tuple(np.concatenate(x) for x in zip(*found))


def document_seeds(texts: list[str], overlap: int, masks: tuple[str, ...], filter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, text and tokens around, for the seeds that the filter lets through."""
    words, first = tokens(texts)
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, 2 * overlap - 1), np.uint64))]
    for mask in masks:
        at, owner = _words.windows(first, len(mask))
        seed = _seeds(words, at, mask)
        maybe = passes(filter, seed)
        at, owner = at[maybe], owner[maybe]
        found.append((seed[maybe], owner, _around(words, first, at, owner, overlap - 1, _OUTSIDE["document"])))
    return tuple(np.concatenate(x) for x in zip(*found))


def passes(filter: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have both of their bits set."""
    bits = (len(filter) * 64).bit_length() - 1
    has = lambda slot: filter[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) != 0
    maybe = np.flatnonzero(has(hashes >> np.uint64(64 - bits)))
    return maybe[has(hashes[maybe] & np.uint64((1 << bits) - 1))]


def verify(item: np.ndarray, document: np.ndarray, passage: np.ndarray, identity: float) -> np.ndarray:
    """The most equal tokens of a passage through each hit, 0 where that is too few or none fits."""
    equal = (item == document).cumsum(axis=1, dtype=np.int32)
    fits = ((item != _OUTSIDE["item"]) & (document != _OUTSIDE["document"])).cumsum(axis=1, dtype=np.int32)
    best = np.zeros(len(item), np.int64)
    for n in np.unique(passage).tolist():
        own = np.flatnonzero(passage == n)
        runs = lambda total: np.c_[total[own, n - 1], total[own, n:] - total[own, :-n]]
        most = np.where(runs(fits) == n, runs(equal), 0).max(axis=1)
        best[own] = np.where(most >= identity * n, most, 0)
    return best


def _in_chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    low, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > CHUNK_CHARS:
            yield low, [t or "" for t in texts[low:i]]
            low, size = i, 0
        size += n + 1
    if texts:
        yield low, [t or "" for t in texts[low:]]


def _tokens_column(around: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in around.astype("<u8")], pa.binary())


def _benchmark_seeds(benchmark: DataFrame, item: str, text: str, masks: tuple[str, ...] | None, overlap: int, identity: float) -> DataFrame:
    rows = benchmark.select(F.col(item).alias("item_id"), F.monotonically_increasing_id().alias("item"), F.col(text).alias("text")).where("text is not null")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in _in_chunks(batch.column(2).to_pylist()):
                seed, owner, passage, around = item_seeds(texts, overlap, identity, masks)
                at = pa.array(owner + low)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(passage), _tokens_column(around)], names=["seed", "item_id", "item", "passage", "item_tokens"])

    schema = rows.select(F.lit(0).cast("long").alias("seed"), "item_id", "item").schema.add("passage", "long").add("item_tokens", "binary")
    return _base.checkpoint(rows.mapInArrow(make, schema))


def _bloom(seeds: DataFrame, n: int) -> np.ndarray:
    """A bit at the upper and one at the lower end of each hash; of a size that MOST_BITS bounds."""
    bits = min(MOST_BITS, max(16, n.bit_length() + 5))
    slots = seeds.select(F.explode(F.array(F.shiftrightunsigned("seed", 64 - bits), F.col("seed").bitwiseAND(F.lit((1 << bits) - 1)))).alias("slot"))
    words = slots.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << bits - 6, np.uint64)
    for r in words.collect():
        out[r["word"]] = r["bits"] & (1 << 64) - 1
    return out


def _hits(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, masks: tuple[str, ...] | None, overlap: int, identity: float) -> DataFrame | None:
    """place (of the row), doc_id, h1, h2 (of the text), item (the row), item_id, passage, equal: verified hits; None if the benchmark has no seeds."""
    seeds = _benchmark_seeds(benchmark, item, item_text, masks, overlap, identity)
    n = seeds.count()
    if not n:
        return None
    lengths = {r[0] for r in seeds.select("passage").distinct().collect()}
    chosen, filter = tuple(wanted_masks(lengths, overlap, identity, masks)), _bloom(seeds, n)
    doc_id = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long").alias("doc_id")
    rows = docs.select(doc_id, F.monotonically_increasing_id().alias("place"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(17), text).alias("h2"), F.col(text).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in _in_chunks(batch.column(4).to_pylist()):
                seed, owner, around = document_seeds(texts, overlap, chosen, filter)
                at = pa.array(owner + low)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), *(batch.column(i).take(at) for i in range(4)), _tokens_column(around)], names=["seed", "doc_id", "place", "h1", "h2", "tokens"])

    schema = rows.select(F.lit(0).cast("long").alias("seed"), "doc_id", "place", "h1", "h2").schema.add("tokens", "binary")
    there = rows.mapInArrow(make, schema)
    if n <= BROADCAST_SEEDS:
        met = there.join(F.broadcast(seeds), "seed")
    else:
        salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = there.withColumn("salt", F.pmod("place", F.lit(SALTS)).cast("int")).join(salted, ["seed", "salt"]).drop("salt")
    return verified(met, ["place", "doc_id", "h1", "h2", "item", "item_id", "passage"], 2 * overlap - 1, identity)


def verified(met: DataFrame, columns: list[str], width: int, identity: float) -> DataFrame:
    """The columns and ``equal`` of the rows for which ``verify`` gives more than 0, in the JVM: a second Python worker for each task would double the memory.

    A character tells of each token whether it is equal (1), another (0) or
    outside of a text (x); passages are cut from these. Both steps are generated
    rows, since the optimizer would copy plain columns into every use of them.
    """
    outside = {name: F.lit(value.to_bytes(8, "little")) for name, value in _OUTSIDE.items()}
    here = lambda c, i: F.substring(c, 8 * i + 1, 8)
    marks = [F.when(here("item_tokens", i) == here("tokens", i), "1").when((here("item_tokens", i) == outside["item"]) | (here("tokens", i) == outside["document"]), "x").otherwise("0") for i in range(width)]
    marked = met.select(*columns, F.explode(F.array(F.concat(*marks))).alias("marks"))
    best = []
    for i in range(width):
        run = F.substring("marks", F.lit(i + 1), F.col("passage").cast("int"))
        fits = (F.col("passage") <= width - i) & (F.instr(run, "x") == 0)
        best.append(F.when(fits, F.length(F.replace(run, F.lit("0"), F.lit("")))).otherwise(0))
    most = (F.greatest(*best) if width > 1 else best[0]).cast("long")
    return marked.select(*columns, F.explode(F.array(most)).alias("equal")).where((F.col("equal") > 0) & (F.col("equal") >= F.lit(float(identity)) * F.col("passage")))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", masks: tuple[str, ...] | None = None, overlap: int = OVERLAP, identity: float = IDENTITY) -> DataFrame:
    """doc_id, item_id, n_equal, n_compared: documents with a passage of a benchmark item.

    A passage is a run of ``overlap`` tokens (all of a shorter item, down to one
    token) laid along the document without gaps, of which at least the share
    ``identity`` is equal; n_equal and n_compared are of the best. One row for
    each pair of rows. Null and empty texts, and texts without letters or
    digits, have none. Repeated documents or items give a row each. Either table
    may be empty; other columns are ignored. Without ``masks`` (for passages of
    ``overlap`` tokens) they follow from overlap and identity, and all passages
    are found; others find what they hit.
    """
    _base.require(docs, "doc_id", text)
    _base.require(benchmark, item, item_text)
    hits = _hits(docs, benchmark, text, item, item_text, masks, overlap, identity)
    if hits is None:
        schema = docs.select("doc_id").schema.add("item_id", benchmark.schema[item].dataType).add("n_equal", "long").add("n_compared", "long")
        return docs.sparkSession.createDataFrame([], schema)
    best = hits.groupBy("place", "doc_id", "item", "item_id").agg(F.max("equal").alias("n_equal"), F.max("passage").alias("n_compared"))
    return best.select("doc_id", "item_id", "n_equal", "n_compared")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", masks: tuple[str, ...] | None = None, overlap: int = OVERLAP, identity: float = IDENTITY) -> DataFrame:
    """The rows of ``docs`` without any passage that ``contaminated`` finds, with all their columns.

    Rows of a text go or stay together. Null and empty texts stay.
    """
    _base.require(docs, text)
    _base.require(benchmark, item, item_text)
    hits = _hits(docs, benchmark, text, item, item_text, masks, overlap, identity)
    if hits is None:
        return docs
    h1, h2 = _base.fresh(docs, "h1"), _base.fresh(docs, "h2")
    gone = _base.checkpoint(hits.select(F.col("h1").alias(h1), F.col("h2").alias(h2)).distinct())
    if gone.limit(_base.BROADCAST_ROWS + 1).count() <= _base.BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, (F.xxhash64(docs[text]) == gone[h1]) & (F.xxhash64(F.lit(17), docs[text]) == gone[h2]), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_equal, n_compared for every document that holds a passage of a benchmark item."""
    return contaminated(_base.table(spark, sf_dir, "documents"), _base.table(spark, sf_dir, "benchmark"))


def overlaps(items: list[tuple], texts: list[str], overlap: int = OVERLAP, identity: float = IDENTITY) -> set[tuple]:
    """(text, item id) by the same seeds and verification, in one process; for tests."""
    seed, owner, passage, around = item_seeds([t for _, t in items], overlap, identity, None)
    filter = np.full(1 << 10, (1 << 64) - 1, np.uint64)
    there, doc, tokens_there = document_seeds(texts, overlap, tuple(wanted_masks(set(passage.tolist()), overlap, identity, None)), filter)
    order = np.argsort(seed, kind="stable")
    low, high = np.searchsorted(seed[order], there, "left"), np.searchsorted(seed[order], there, "right")
    hit = np.repeat(np.arange(len(there)), high - low)
    entry = order[np.arange(len(hit)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]
    good = verify(around[entry], tokens_there[hit], passage[entry], identity) > 0
    return {(d, items[i][0]) for d, i in zip(doc[hit[good]].tolist(), owner[entry[good]].tolist())}


def brute_force(docs: list[tuple], items: list[tuple], overlap: int = OVERLAP, identity: float = IDENTITY) -> set[tuple]:
    """(doc_id, item_id) by comparing every alignment of every pair; for tests."""
    import regex

    split = lambda t: regex.findall(r"[^\W_]+", (t or "").lower())
    found = set()
    for i, q in items:
        a = split(q)
        window = min(overlap, len(a))
        if not a:
            continue
        for d, t in docs:
            b = split(t)
            for zero in range(window - len(a), len(b) - window + 1):
                equal = [0 <= zero + k < len(b) and b[zero + k] == a[k] for k in range(len(a))]
                if any(0 <= zero + k and zero + k + window <= len(b) and sum(equal[k : k + window]) >= identity * window for k in range(len(a) - window + 1)):
                    found.add((d, i))
                    break
    return found
