"""Substring deduplication with prefix-partitioned suffix trees.

Suffixes start at words. The trees are sparse: of a window's 13 words, the five
in a row with the smallest hash are its anchor, so equal windows have theirs at
the same place, and only suffixes at anchors are dealt, each with the words of
all windows that it anchors (about one suffix for five windows). They are dealt
to subtrees by word prefixes of variable length: a first pass counts, over all
rows, the windows below each prefix cell of one to five words; a cell with more
windows than a task may hold is split by the next word, and below five words by
the whole window; light cells are put together. So each subtree fits in memory,
however frequent a word is.

A subtree holds the words themselves. It numbers its distinct words in order,
sorts its windows by these numbers and takes the longest common prefix of
neighbours: runs of 13 words in common are the internal nodes of that depth, and
what lies below one and isn't of its smallest document is a repeat. Hashes only
choose anchors and subtrees; equality is that of words.

A task sends a suffix whose words it has sent before, with a smaller doc_id, to
no subtree: it is known to repeat. So a passage that a third of all rows share
reaches its subtree once for each task, and the known repeats are dealt evenly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base, _words

WINDOW = 13
#: Words of an anchor, and so of the longest prefix that suffixes are dealt by.
GRAM = 5
WINDOWS_PER_TREE = 2_000_000
CELLS = 1 << 13
#: Rows in a chunk of this size are looked at together.
CHUNK_BYTES = 4 << 20
#: Repeated passages that a task remembers from chunk to chunk.
REMEMBERED = 50_000
#: Words of a subtree that are numbered together.
CODED_AT_ONCE = 16 << 20

_LEAVES = "tree int, known boolean, numbers binary, words binary"
_RANGES = "bucket long, numbers binary"


class Suffixes:
    """The anchored suffixes of a chunk of texts: leaf i has the words a[i] to b[i] of one text, with n[i] windows."""

    def __init__(self, raw: list[bytes], window: int):
        self.window, self.gram = window, min(GRAM, window)
        chunk = _words.Chunk(raw)
        self.first, self.words = chunk.first, chunk.hashes()
        self.joined, self.start, self.end = chunk.single_spaced()
        at, owner = _words.windows(chunk.first, window)
        anchor = self._anchors(at)
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(at) else np.zeros(0, np.int64)
        self.anchor, self.owner, self.a = anchor[new], owner[new], at[new]
        self.n = np.diff(np.r_[new, len(at)])
        self.b = self.a + self.n + window - 1

    def _anchors(self, at: np.ndarray) -> np.ndarray:
        """Where the leftmost of the smallest anchors inside each window begins."""
        places = len(self.words) - self.gram + 1
        if not len(at):
            return at
        bits = np.uint64(max(1, places.bit_length()))
        place = np.arange(places)
        value = _words.window_hashes(self.words, place, self.gram) >> bits << bits | place.astype(np.uint64)
        width, step = self.window - self.gram + 1, 1
        while 2 * step <= width:
            value = np.minimum(value[:-step], value[step:])
            step *= 2
        smallest = np.minimum(value[at], value[at + width - step])
        return (smallest & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)

    def cells(self) -> list[np.ndarray]:
        """The cell of each leaf at each level: a hash of its first words."""
        return [(_words.window_hashes(self.words, self.anchor, k + 1) >> np.uint64(40)).astype(np.int64) % CELLS for k in range(self.gram)]

    def deal(self, trees: np.ndarray, n: int) -> np.ndarray:
        """The subtree of each leaf; those below a heavy longest prefix are cut into single windows first."""
        tree = np.full(len(self.a), -1)
        for level, cell in enumerate(self.cells()):
            rest = tree < 0
            if not rest.any():
                return tree
            tree[rest] = trees[level][cell[rest]]
        rest = tree < 0
        if not rest.any():
            return tree
        times = np.where(rest, self.n, 1)
        single = np.repeat(rest, times)
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        tree, self.owner, self.a, self.n = (np.repeat(x, times) for x in (tree, self.owner, self.a, self.n))
        self.a = self.a + step
        self.n = np.where(single, 1, self.n)
        self.b = self.a + self.n + self.window - 1
        tree[single] = (_words.window_hashes(self.words, self.a[single], self.window) % np.uint64(n)).astype(np.int64)
        return tree

    def contexts(self) -> list[bytes]:
        """The words of each leaf, parted by one space."""
        joined = self.joined
        return [joined[x:y] for x, y in zip(self.start[self.a].tolist(), self.end[self.b - 1].tolist())]


def _prefix_counts(docs: DataFrame, window: int) -> np.ndarray:
    """Windows of all rows below each cell: prefix lengths x CELLS numbers, whatever the input's size."""
    levels = min(GRAM, window)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((levels, CELLS), np.int64)
        for _, raw in _words.rows_in_chunks(batches, limit=CHUNK_BYTES):
            leaves = Suffixes(raw, window)
            for level, cells in enumerate(leaves.cells()):
                total[level] += np.bincount(cells, leaves.n, CELLS).astype(np.int64)
        level, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[level, cell])], names=["level", "cell", "n"])

    rows = docs.select("text").mapInArrow(add_up, "level int, cell int, n long").groupBy("level", "cell").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((levels, CELLS), np.int64)
    for r in rows:
        total[r["level"], r["cell"]] = r["n"]
    return total


def plan_trees(counts: np.ndarray, budget: int, at_least: int) -> tuple[np.ndarray, int]:
    """tree[level, cell], or -1 where the next word decides; the last level spreads by the whole window.

    A cell below a split one counts as full as it is for all prefixes, an upper bound.
    """
    total = int(counts[0].sum())
    budget = max(1, min(budget, -(-total // at_least)))
    trees = np.zeros(counts.shape, np.int64)
    n = 0
    for level in range(len(counts)):
        heavy = counts[level] > budget
        load = np.where(heavy, 0, counts[level])
        trees[level] = np.where(heavy, -1, n + np.cumsum(load) // budget)
        n = int(max(n, trees[level].max() + 1))
        if not heavy.any():
            break
    return trees, max(n, 1)


def _merged(ids: np.ndarray, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of words joined where they touch, by document and place."""
    order = np.lexsort((a, keys, ids))
    ids, keys, a, b = ids[order], keys[order], a[order], b[order]
    if not len(ids):
        return ids, keys, a, b
    # Ends don't fall behind inside one document: a running maximum over documents in order.
    edge = np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]
    group = np.cumsum(edge) - 1
    reach = np.maximum.accumulate(group * (1 << 40) + b)
    new = edge | np.r_[True, group[1:] * (1 << 40) + a[1:] > reach[:-1]]
    begins = np.flatnonzero(new)
    return ids[begins], keys[begins], a[begins], (reach - group * (1 << 40))[np.r_[begins[1:] - 1, len(ids) - 1]]


def _numbers(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c, "<i8").tobytes() for c in columns))


def _from_numbers(data: bytes) -> np.ndarray:
    """Four columns."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8").reshape(4, -1)


def _ranges(ids: np.ndarray, keys: np.ndarray, a: np.ndarray, b: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, documents and ranges) for each bucket of documents."""
    ids, keys, a, b = _merged(ids, keys, a, b)
    bucket = _bucket(ids, n_buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, ids, keys, a, b = bucket[order], ids[order], keys[order], a[order], b[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(ids) else np.zeros(1, np.int64)
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(bucket[x]), _numbers(ids[x:y], keys[x:y], a[x:y], b[x:y])


def _leaves(docs: DataFrame, window: int, trees: np.ndarray, n_trees: int, share: bool = True) -> DataFrame:
    """Rows for subtrees: ids, places and windows of leaves, and their words; and, if share, rows of known repeats."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, task = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
        remembered: dict[bytes, int] = {}
        for number, (columns, raw) in enumerate(_words.rows_in_chunks(batches, limit=CHUNK_BYTES)):
            named = [i for i, x in enumerate(columns["doc_id"]) if x is not None]
            named.sort(key=columns["doc_id"].__getitem__)
            ids = np.array([columns["doc_id"][i] for i in named], np.int64)
            leaves = Suffixes([raw[i] for i in named], window)
            tree = leaves.deal(trees, n_trees)
            if not len(tree):
                continue
            keys = np.array([columns["text_key"][i] for i in named], np.int64)
            who, which, texts = ids[leaves.owner], keys[leaves.owner], leaves.contexts()
            sent = np.ones(len(tree), bool)
            if share:
                repeats = _sent_before(texts, who.tolist(), remembered)
                sent[repeats[0]] = False
                known = np.array(repeats[1], np.int64)
            rows = []
            order = np.argsort(tree, kind="stable")
            order = order[sent[order]]
            cuts = np.flatnonzero(np.r_[True, tree[order][1:] != tree[order][:-1], True]) if len(order) else np.zeros(1, np.int64)
            place = leaves.a - leaves.first[leaves.owner]
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = order[x:y]
                rows.append((int(tree[part[0]]), False, _numbers(who[part], which[part], place[part], leaves.n[part]), press.compress(b"\n".join([texts[i] for i in part.tolist()]))))
            if share and len(known):
                # By task and chunk: numbers of chunks alone would bring the first ones of all tasks together.
                any_tree = int(_words.mix(np.array([task << 32 | number]))[0] % np.uint64(n_trees))
                rows.append((any_tree, True, _numbers(who[known], which[known], place[known], place[known] + leaves.n[known] + window - 1), b""))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], names=["tree", "known", "numbers", "words"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(emit, _LEAVES)


def _sent_before(texts: list[bytes], who: list[int], remembered: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """Leaves (in ascending order of document) whose words went out with the same or a smaller document, and of these the ones with a smaller."""
    first: dict[bytes, int] = {}
    again, known = [], []
    for i, (text, doc) in enumerate(zip(texts, who)):
        seen = first.setdefault(text, doc)
        if seen is doc and text not in remembered:
            continue
        before = remembered.get(text)
        if before is not None and before < seen:
            seen = first[text] = before
        if seen < doc:
            again.append(i)
            known.append(i)
    for i in known:
        if len(remembered) >= REMEMBERED:
            remembered.clear()
        remembered[texts[i]] = first[texts[i]]
    return again, known


def _in_order(codes: np.ndarray, at: np.ndarray, ids: np.ndarray, window: int, bits: int) -> np.ndarray:
    """The order of the windows at these places by their words, then by document.

    As many words as 64 bits hold are compared at once; windows that differ by
    then are settled, and only runs of equal ones are sorted by the words after.
    """

    def packed(places: np.ndarray, start: np.ndarray, k: int, n: int) -> np.ndarray:
        key = start
        for j in range(k, k + n):
            key = key << np.uint64(bits) | codes[places + j]
        return key

    k = min(window, 64 // bits)
    key = packed(at, np.zeros(len(at), np.uint64), 0, k)
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(at), bool)
    same[1:] = key[1:] == key[:-1]
    while True:
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        if not len(tied):
            return order
        rows, again = order[tied], same[tied]
        group = np.cumsum(~again).astype(np.uint64)
        if k == window:
            order[tied] = rows[np.lexsort((ids[rows], group))]
            return order
        n = min(window - k, (64 - int(group[-1]).bit_length()) // bits)
        if n:
            key = packed(at[rows], group, k, n)
            into = np.argsort(key)
        else:  # so many windows and words that a run and a word take more than 64 bits
            n = 1
            key = codes[at[rows] + k]
            into = np.lexsort((key, group))
        order[tied] = rows[into]
        key = key[into]
        again[1:] &= key[1:] == key[:-1]
        same[tied] = again
        k += n


class Subtree:
    """The windows of leaves in the order of their words, and the words that each has in common with the one before."""

    def __init__(self, window: int):
        self.window = window
        self.numbers: list[np.ndarray] = []
        self.codes: list[pa.DictionaryArray] = []
        self.waiting: list[bytes] = []
        self.size = 0

    def add(self, numbers: bytes, words: bytes) -> None:
        self.numbers.append(_from_numbers(numbers))
        self.waiting.append(zstandard.ZstdDecompressor().decompress(words))
        self.size += len(self.waiting[-1])
        if self.size > CODED_AT_ONCE:
            self._code()

    def _code(self) -> None:
        """Numbers the words that wait, each with the space after it: Arrow's table of values compares bytes."""
        data = np.frombuffer(b"".join([x + b" " for x in self.waiting]).replace(b"\n", b" "), np.uint8)
        ends = np.r_[0, np.flatnonzero(data == 32) + 1]
        self.codes.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode())
        self.waiting, self.size = [], 0

    def sort(self) -> None:
        if self.waiting:
            self._code()
        all_words = pa.concat_arrays([x.dictionary for x in self.codes]).dictionary_encode()
        words = pc.binary_slice(all_words.dictionary, 0, -1)
        in_order = pc.array_sort_indices(words)
        self.sorted_words = words.take(in_order)
        rank = np.empty(len(words), np.uint32)
        rank[in_order.to_numpy()] = np.arange(len(words), dtype=np.uint32)
        rank = rank[all_words.indices.to_numpy()]
        before = np.cumsum([0] + [len(x.dictionary) for x in self.codes])
        codes = np.concatenate([rank[low:][x.indices.to_numpy()] for low, x in zip(before.tolist(), self.codes)])
        self.codes.clear()
        ids, keys, place, n = np.concatenate(self.numbers, axis=1)
        self.numbers.clear()
        size = n + self.window - 1
        leaf = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(leaf)) - np.repeat(np.cumsum(n) - n, n)
        at = (np.cumsum(size) - size)[leaf] + step
        order = _in_order(codes, at, ids[leaf], self.window, max(1, len(words).bit_length()))
        leaf, step, at = leaf[order], step[order], at[order]
        self.ids, self.keys, self.place = ids[leaf], keys[leaf], place[leaf] + step
        self.common = np.zeros(len(at), np.int64)
        going = np.arange(1, len(at))
        for j in range(self.window):
            going = going[codes[at[going] + j] == codes[at[going - 1] + j]]
            self.common[going] += 1
        self.at, self.sequence = at, codes

    @cached_property
    def words(self) -> list[bytes]:
        return self.sorted_words.to_pylist()

    def nodes(self) -> np.ndarray:
        """Where each internal node at the depth of a window, or a leaf of its own, begins."""
        return np.flatnonzero(self.common < self.window)

    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents and ranges of the windows that also start in a smaller document."""
        begins = self.nodes()
        smallest = np.repeat(self.ids[begins], np.diff(np.r_[begins, len(self.ids)]))
        later = self.ids > smallest
        return self.ids[later], self.keys[later], self.place[later], self.place[later] + self.window


def _bucket(doc_id: np.ndarray, n: int) -> np.ndarray:
    return (doc_id ^ (doc_id >> 17) ^ (doc_id >> 31)) % n


def _bucket_column(doc_id: str, n: int) -> Column:
    """The same in Spark."""
    x = F.col(doc_id)
    return F.pmod(x.bitwiseXOR(F.shiftright(x, 17)).bitwiseXOR(F.shiftright(x, 31)), F.lit(n))


def _repeats(leaves: DataFrame, n: int, n_buckets: int, window: int) -> DataFrame:
    """Repeated ranges of words by bucket of documents. One partition, and so one task, for each subtree; known repeats pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(*found: np.ndarray) -> pa.RecordBatch:
            rows = list(_ranges(*found, n_buckets))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "numbers"])

        tree = Subtree(window)
        for batch in batches:
            for known, numbers, words in zip(*(batch.column(c).to_pylist() for c in ("known", "numbers", "words"))):
                if known:
                    yield made(*_from_numbers(numbers))
                else:
                    tree.add(numbers, words)
        if tree.numbers:
            tree.sort()
            yield made(*tree.repeats())

    return leaves.repartitionById(n, F.col("tree")).mapInArrow(run, _RANGES)


def repeat_nodes(docs: DataFrame, window: int = WINDOW, windows_per_tree: int = WINDOWS_PER_TREE) -> DataFrame:
    """The deep internal nodes: words (joined by one space), first_doc (the smallest below it) and n (windows below it).

    Rows without a doc_id or with fewer words than a window have none.
    """
    _base.require(docs, "doc_id", "text")
    trees, n = plan_trees(_prefix_counts(docs, window), windows_per_tree, 2 * _base.shuffle_partitions(docs.sparkSession))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Subtree(window)
        for batch in batches:
            for numbers, words in zip(batch.column("numbers").to_pylist(), batch.column("words").to_pylist()):
                tree.add(numbers, words)
        if tree.numbers:
            tree.sort()
            begins = tree.nodes()
            size = np.diff(np.r_[begins, len(tree.ids)])
            begins, size = begins[size > 1], size[size > 1]
            text = [b" ".join([tree.words[w] for w in tree.sequence[x : x + window].tolist()]).decode() for x in tree.at[begins].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(tree.ids[begins]), pa.array(size)], names=["words", "first_doc", "n"])

    return _leaves(own, window, trees, n, share=False).repartitionById(n, F.col("tree")).mapInArrow(run, "words string, first_doc long, n long")


def _by_document(parts: list[np.ndarray]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    ids, keys, a, b = _merged(*np.concatenate(parts, axis=1))
    cuts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]), True])
    spans = list(zip(a.tolist(), b.tolist()))
    return {(int(ids[x]), int(keys[x])): spans[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())}


def substring_dedup(docs: DataFrame, window: int = WINDOW, windows_per_tree: int = WINDOWS_PER_TREE) -> DataFrame:
    """Removes each word that lies in a run of ``window`` words which also starts in a document of smaller doc_id.

    Needs doc_id (long) and text; other columns of any name are ignored. Returns
    for each input row: doc_id, n_words, n_removed, spans (removed word ranges,
    end exclusive) and kept (the other words, joined by one space).

    Words are runs of anything but space, tab, line feed, vertical tab, form
    feed and return. Runs are judged on the input. Null or empty text: no words,
    kept is empty. Null doc_id: smaller than none and later than none, so the
    row keeps all words and makes no other lose any. Rows that repeat a doc_id
    and differ in text each lose their own places' words, and never make each
    other lose any. An empty table gives an empty result.
    """
    _base.require(docs, "doc_id", "text")
    spark = docs.sparkSession
    counts = _prefix_counts(docs, window)
    trees, n = plan_trees(counts, windows_per_tree, 2 * _base.shuffle_partitions(spark))
    # A bucket's ranges are held at once: as many buckets as keep that near a subtree's size.
    n_buckets = max(_base.shuffle_partitions(spark), int(counts[0].sum()) // windows_per_tree + 1)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    # Texts tell rows of one doc_id apart; where no doc_id has two, there is nothing to carry.
    if own.where("doc_id is not null").groupBy("doc_id").agg((F.min("text_key") == F.max("text_key")).alias("one")).where("not one").isEmpty():
        own = own.withColumn("text_key", F.lit(0).cast("long"))
    repeats = _repeats(_leaves(own, window, trees, n), n, n_buckets, window)
    ranges = repeats.select("bucket", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("text_key"), F.lit(None).cast("string").alias("text"), "numbers")
    texts = own.select(F.coalesce(_bucket_column("doc_id", n_buckets), F.pmod(F.xxhash64("text"), F.lit(n_buckets))).alias("bucket"), "doc_id", "text_key", "text", F.lit(None).cast("binary").alias("numbers"))
    both = ranges.unionByName(texts).withColumn("is_text", F.col("numbers").isNull())
    # A bucket's ranges come before its texts.
    dealt = both.repartitionById(n_buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "is_text").drop("is_text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, repeated = None, [], {}
        for columns, raw in _words.rows_in_chunks(batches, limit=CHUNK_BYTES):
            chunk = _words.Chunk(raw)
            joined, start, end = chunk.single_spaced()
            first = chunk.first.tolist()
            out = []
            for k, (bucket, doc_id, key, numbers) in enumerate(zip(*(columns[c] for c in ("bucket", "doc_id", "text_key", "numbers")))):
                if bucket != current:
                    current, parts, repeated = bucket, [], {}
                if numbers is not None:
                    parts.append(_from_numbers(numbers))
                    continue
                if parts:
                    repeated, parts = _by_document(parts), []
                a, b = first[k], first[k + 1]
                removed = repeated.get((doc_id, key), ())
                pieces, at = [], a
                for x, y in (*removed, (b - a, b - a)):
                    if a + x > at:
                        pieces.append(joined[start[at] : end[a + x - 1]])
                    at = a + y
                out.append((doc_id, b - a, sum(y - x for x, y in removed), [{"start": x, "end": y} for x, y in removed], b" ".join(pieces).decode()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()))], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return dealt.mapInArrow(apply, "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the number of removed spans."""
    out = substring_dedup(_base.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


def brute_force(rows: list[tuple], window: int = WINDOW) -> dict:
    """The contract, word by word; for tests."""
    words = {i: (t or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") for i, t in rows}
    words = {i: [w for w in ws if w] for i, ws in words.items()}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for a in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][a : a + window]), i)
    out = {}
    for i, ws in words.items():
        keep = [True] * len(ws)
        for a in range(len(ws) - window + 1):
            if first[tuple(ws[a : a + window])] < i:
                keep[a : a + window] = [False] * window
        kept = b" ".join(w for w, k in zip(ws, keep) if k)
        out[i] = (len(ws), len(ws) - sum(keep), hashlib.sha256(kept).hexdigest())
    return out
