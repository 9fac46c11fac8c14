"""Token-id files of patched frame-of-reference blocks.

Ids are cut into blocks of 128. Each block stores its minimum, the differences
to it in a bit width chosen among percentiles of its differences, and what is
too large for that width in an exception list. A file holds many documents:

    magic "PFR2", then little-endian: u32 block length, u64 ids, u32 documents,
    u32 documents without a doc_id (the first ones), u32 blocks; i64 doc_id of each document, u32 ids of each document; u32 start
    of each block, counted from the first; the blocks.
    A block: u32 minimum, u16 exceptions, u8 width, u8 zero; the packed
    differences (width * 16 bytes); u8 place and u32 high bits of each exception.

Files are written as rows of a table (one binary column), so any store that
Spark reaches can hold them; the files of all partitions follow each other in
ascending doc_id.
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _base, _words

BLOCK = 128
PERCENTILES = (0.9, 0.95, 0.98, 1.0)
#: UTF-8 that goes into one file, about; a longer text has a file of its own.
BYTES_PER_FILE = 2 << 20
END_ID = 2
CACHED_WORDS = 300_000
VOCABULARY = "word_bpe_49k.json"

_HEAD = struct.Struct("<4sIQIII")
_BLOCK_HEAD = np.dtype([("minimum", "<u4"), ("exceptions", "<u2"), ("width", "u1"), ("zero", "u1")])


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def encode_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, unnamed: int = 0) -> bytes:
    """One file; ids are those of all documents one after the other, of which the first ``unnamed`` have no doc_id."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    values = np.zeros(blocks * BLOCK, np.int64)
    values[:n] = ids
    if n:
        values[n:] = ids[-1]
    values = values.reshape(blocks, BLOCK)
    minimum = values.min(axis=1) if blocks else np.zeros(0, np.int64)
    values = values - minimum[:, None]
    ranked = np.sort(values.astype(np.uint32), axis=1).astype(np.int64)
    width, size = np.zeros(blocks, np.int64), np.full(blocks, np.iinfo(np.int64).max)
    for p in PERCENTILES:
        w = _bit_length(ranked[:, int(np.ceil(p * BLOCK)) - 1])
        s = w * (BLOCK // 8) + 5 * (ranked >> w[:, None] != 0).sum(axis=1)
        better = s < size
        width[better], size[better] = w[better], s[better]
    high = values >> width[:, None]
    row, place = np.nonzero(high)
    exceptions = np.bincount(row, minlength=blocks)
    length = _BLOCK_HEAD.itemsize + width * (BLOCK // 8) + 5 * exceptions
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    head = np.zeros(blocks, _BLOCK_HEAD)
    head["minimum"], head["exceptions"], head["width"] = minimum, exceptions, width
    if blocks:
        out[start[:, None] + np.arange(8)] = head.view(np.uint8).reshape(blocks, 8)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        cell = 2 if w <= 16 else 4
        low = (values[at] & ((1 << w) - 1)).astype(f"<u{cell}").view(np.uint8).reshape(len(at), BLOCK, cell)
        bits = np.unpackbits(low, axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
        out[start[at][:, None] + 8 + np.arange(w * (BLOCK // 8))] = packed
    tail = start + 8 + width * (BLOCK // 8)
    rank = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
    out[tail[row] + rank] = place
    spill = high[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(tail[row] + exceptions[row] + 4 * rank)[:, None] + np.arange(4)] = spill
    return b"".join([_HEAD.pack(b"PFR2", BLOCK, n, len(doc_ids), unnamed, blocks), doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), start.astype("<u4").tobytes(), out.tobytes()])


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc ids, ids of each document, all token ids (uint32), and how many documents have no doc_id, from the bytes alone."""
    magic, block, n, docs, unnamed, blocks = _HEAD.unpack_from(data)
    if magic != b"PFR2" or block != BLOCK:
        raise ValueError("not a token file of this format")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    counts = np.frombuffer(data, "<u4", docs, at + 8 * docs)
    start = np.frombuffer(data, "<u4", blocks, at + 12 * docs).astype(np.int64)
    body = np.frombuffer(data, np.uint8, offset=at + 12 * docs + 4 * blocks)
    if not blocks:
        return doc_ids, counts, np.zeros(0, np.uint32), unnamed
    head = body[start[:, None] + np.arange(8)].copy().view(_BLOCK_HEAD)[:, 0]
    width, exceptions = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    values = np.zeros((blocks, BLOCK), np.int64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        packed = body[start[rows][:, None] + 8 + np.arange(w * (BLOCK // 8))]
        cell = 2 if w <= 16 else 4
        bits = np.zeros((len(rows), BLOCK, 8 * cell), np.uint8)
        bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        values[rows] = np.packbits(bits, axis=2, bitorder="little").view(f"<u{cell}")[:, :, 0]
    row = np.repeat(np.arange(blocks), exceptions)
    rank = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
    tail = start + 8 + width * (BLOCK // 8)
    place = body[tail[row] + rank]
    high = body[(tail[row] + exceptions[row] + 4 * rank)[:, None] + np.arange(4)].copy().view("<u4")[:, 0].astype(np.int64) if len(row) else np.zeros(0, np.int64)
    values[row, place] |= high << width[row]
    values += head["minimum"].astype(np.int64)[:, None]
    return doc_ids, counts, values.ravel()[:n].astype(np.uint32), unnamed


#: Steps of a vocabulary file's rules that never look across white space.
_LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}


def _steps(rule: dict | None, inner: str) -> list[dict]:
    return [] if rule is None else [x for step in rule[inner] for x in _steps(step, inner)] if rule["type"] == "Sequence" else [rule]


def splits_at_space(rules: dict) -> bool:
    """Whether a vocabulary file's rules drop white space and never join what it parts, so that a text's ids are those of its words."""
    import regex

    for step in _steps(rules.get("normalizer"), "normalizers"):
        if step["type"] not in _LOCAL and (step["type"], step.get("pattern"), step.get("content")) != ("Replace", {"Regex": r"\s+"}, " "):
            return False
    first, *others = _steps(rules.get("pre_tokenizer"), "pretokenizers") or [{"type": ""}]
    if (first["type"], first.get("behavior"), first.get("invert")) != ("Split", "Removed", True) or "Regex" not in first["pattern"]:
        return False
    if any(x["type"] != "ByteLevel" or x["add_prefix_space"] or x["use_regex"] for x in others):
        return False
    found = regex.compile(first["pattern"]["Regex"]).findall
    probes = ["a", "B", "7", "'", "s", "'s", "é", "漢", "$", "-", "\u0301"]
    if any(found(x + space + y) != found(x) + found(y) for space in " \t\n\x0b\x0c\r" for x in probes for y in probes):
        return False
    return not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in rules.get("added_tokens", ())) and not rules.get("truncation") and not rules.get("padding")


#: Of bytes in _kinds: white space, and bytes whose words go through the slower ways.
_SPACE, _ODD = 0, 15


def _kinds(parted: Callable[[str], list[str]], special: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and whether the pattern cuts between two bytes of kinds a and b, at [16 * a + b].

    Plain bytes have kinds from 1 on: ASCII letters, digits and marks without
    those of contractions and special tokens, where neighbours alone decide about
    a cut. If they don't in all short strings of kinds, no byte is plain.
    """
    kind = np.full(256, _ODD, np.uint8)
    kind[np.flatnonzero(_words._SPACE)] = _SPACE
    cut = np.zeros(256, bool)
    if any(x.isascii() and x.isalnum() for x in special):
        return kind, cut
    plain = [c for c in map(chr, range(33, 127)) if c != "'" and (c.isalnum() or not any(c in x for x in special))]
    joined = {c: (*(parted(c + x) == [c + x] for x in plain), *(parted(x + c) == [x + c] for x in plain)) for c in plain}
    alike = [[c for c in plain if joined[c] == x] for x in dict.fromkeys(joined.values())]
    if len(alike) >= _ODD:
        return kind, cut
    own = kind.copy()
    for k, chars in enumerate(alike, 1):
        own[[ord(c) for c in chars]] = k
    for a, x in enumerate(alike, 1):
        for b, y in enumerate(alike, 1):
            cut[16 * a + b] = parted(x[0] + y[-1]) != [x[0] + y[-1]]

    def as_cut(text: str) -> list[str]:
        k = [int(own[ord(c)]) for c in text]
        at = [0, *(i for i in range(1, len(k)) if cut[16 * k[i - 1] + k[i]]), len(k)]
        return [text[x:y] for x, y in zip(at, at[1:])]

    ends = [c for x in alike for c in dict.fromkeys((x[0], x[-1]))]
    shorts = ["".join(x) for n in (1, 2, 3, 4) for x in itertools.product(ends, repeat=n)]
    longs = ["".join(x) * 50 for n in (1, 2) for x in itertools.product(plain, repeat=n)]
    if all(parted(x) == as_cut(x) for x in (*shorts, *longs[:: 1 + len(longs) // 300], "".join(plain))):
        return own, cut
    return kind, np.zeros(256, bool)


class _Kept(dict):
    """Ids of words or parts of words, each found once; two generations, so that rare ones go."""

    def __init__(self, make: Callable[[bytes | str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, text: bytes | str) -> bytes:
        found = self.old.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= 64:
            self[text] = found
        return found

    def trim(self) -> None:
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of texts by a public tokenizer, the same as encoding each text whole.

    Where the vocabulary file's rules drop white space and never join what it
    parts, a text's ids are those of its words. Words of plain bytes are cut into
    parts for a whole chunk at once; others one by one by the pattern in the
    file. The library's model and byte letters give the ids of parts, which are
    kept while there is room. Words beyond Latin-1, with control characters or
    with a special token go through the library's whole path, and with any other
    vocabulary all texts do.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.by_word = splits_at_space(rules)
        if self.by_word:
            first, *others = _steps(rules["pre_tokenizer"], "pretokenizers")
            self.parted = regex.compile(first["pattern"]["Regex"]).findall
            self.lower = any(x["type"] == "Lowercase" for x in _steps(rules.get("normalizer"), "normalizers"))
            shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            #: The letters that stand for the bytes of each letter of Latin-1.
            self.letters = {c: "".join([x for x, _ in shown(chr(c))]) for c in range(256)} if others else {}
            self.special = [t["content"] for t in rules.get("added_tokens", ())]
            #: Control characters, on whose class libraries differ.
            self.odd = regex.compile(r"[^\x00-\xff]|[\x00-\x08\x0e-\x1f\x7f-\xa0]").search
            #: Whether the pattern takes letters in a row as one part.
            self.runs = all(self.parted(x * n) == [x * n] for x in ("a", "Zq", "é", "aß") for n in (1, 2, 9, 100))
            self.kind, self.cut = _kinds(self.parted, self.special)
            self.plain = bytes(np.flatnonzero((self.kind != _SPACE) & (self.kind != _ODD)).tolist())
            shown = self.plain.lower() if self.lower else self.plain
            self.shown = np.frombuffer(bytes(range(256)).translate(bytes.maketrans(self.plain, shown)), np.uint8)
        self.parts = _Kept(self._part)
        self.units = _Kept(self._unit)

    def _part(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if self.runs and word.isalpha() and (raw.isascii() or max(word) <= "\xff"):
            return self.parts[word.lower() if self.lower else word]
        if self.odd(word) or any(x in word for x in self.special):
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        parts = self.parts
        return b"".join([parts[x] for x in self.parted(word.lower() if self.lower else word)])

    def _unit(self, raw: bytes) -> bytes:
        """Of a part of plain bytes, or of a whole word that has others."""
        if raw.translate(None, self.plain):
            return self._word(raw)
        ids = [t.id for t in self.model.tokenize(raw.decode())]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _cut(self, chunk: _words.Chunk) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The parts of plain words and the other words whole, one after the other, and where each text's begin."""
        data = self.shown[chunk.data]
        kind = self.kind[data]
        at = np.flatnonzero(self.cut[kind[:-1] * np.uint8(16) + kind[1:]]) + 1
        odd = np.zeros(len(chunk.start), bool)
        odd[np.searchsorted(chunk.start, np.flatnonzero(kind == _ODD), "right") - 1] = True
        if odd.any():
            at = at[~odd[np.searchsorted(chunk.start, at, "right") - 1]]
            start, size = chunk.start[odd], (chunk.end - chunk.start)[odd]
            own = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            data[own] = chunk.data[own]
        begins, ends = np.zeros(len(data), bool), np.zeros(len(data), bool)
        begins[chunk.start] = begins[at] = ends[chunk.end] = ends[at] = True
        begin = np.flatnonzero(begins)
        bounds = np.r_[0, np.cumsum(np.flatnonzero(ends) - begin)]
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(data[kind != _SPACE])])
        return units.dictionary_encode(), np.searchsorted(begin, chunk.text_start)

    def encode(self, raw: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, each closed by end_id, and how many each has."""
        if self.by_word:
            coded, first = self._cut(_words.Chunk(raw))
            units, kind = self.units, coded.indices.to_numpy()
            _, bounds, data = coded.dictionary.buffers()
            bounds, joined = np.frombuffer(bounds, np.int64).tolist(), data.to_pybytes()
            found = [units[joined[a:b]] for a, b in itertools.pairwise(bounds[: len(coded.dictionary) + 1])]
            flat = np.frombuffer(b"".join(found), "<u4")
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            begin = np.cumsum(size) - size
            n = size[kind]
            stop = np.r_[0, np.cumsum(n)]
            ids = flat[np.arange(int(stop[-1])) + np.repeat(begin[kind] - stop[:-1], n)]
            ends = stop[first]
            self.parts.trim()
            units.trim()
        else:
            found = [np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast([x.decode() for x in raw], add_special_tokens=False)]
            ends = np.cumsum([0] + [len(x) for x in found])
            ids = np.concatenate([np.zeros(0, "<u4"), *found])
        return np.insert(ids, ends[1:], end_id), np.diff(ends) + 1


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_FILES = "part int, seq int, n_ids long, n_docs long, content binary"


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, bytes_per_file: int = BYTES_PER_FILE, text: str = "text") -> None:
    """Writes the ids of all documents, each ended by end_id, as a table of files in ascending doc_id order.

    Null texts have the end id only. Null doc_ids stand first, and files say how
    many they are; repeated doc_ids follow each other by a hash of the text. A document is never cut between files, so a very long one makes a
    larger file. An empty table makes no files.
    """
    _base.require(docs, "doc_id", text)
    n = _base.shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    dealt = rows.repartitionByRange(n, "doc_id", "key").sortWithinPartitions("doc_id", "key").withColumn("part", F.spark_partition_id()).select("part", "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seq = _encoder(tokenizer).encode, 0
        for columns, raw in _words.rows_in_chunks(batches, limit=bytes_per_file):
            ids, counts = encode(raw, end_id)
            unnamed = columns["doc_id"].count(None)
            content = encode_file(np.array([i or 0 for i in columns["doc_id"]], np.int64), counts, ids, unnamed)
            yield pa.RecordBatch.from_arrays([pa.array(columns["part"][:1], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([content], pa.binary())], names=["part", "seq", "n_ids", "n_docs", "content"])
            seq += 1

    dealt.mapInArrow(write, _FILES).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (binary, little-endian unsigned 32 bits), decoded from the files; start counts all ids before."""
    files = spark.read.schema(_FILES).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each written partition.
    before_parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("file_start")).join(before_parts, "part").select("part", "seq", (F.col("part_start") + F.col("file_start")).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, counts, ids, unnamed = decode_file(batch.column(2)[k].as_py())
                ends = np.cumsum(counts.astype(np.int64))
                starts = ends - counts
                raw = ids.astype("<u4").tobytes()
                cut = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                same = lambda i, t: pa.array([batch.column(i)[k].as_py()] * len(doc_ids), t)
                yield pa.RecordBatch.from_arrays([same(0, pa.int32()), same(1, pa.int32()), pa.array(doc_ids.astype(np.int64), mask=np.arange(len(doc_ids)) < unnamed), pa.array(starts), pa.array(counts.astype(np.int64)), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(cut, pa.binary())], names=["part", "seq", "doc_id", "own_start", "n_tokens", "ids_crc32", "ids"])

    decoded = files.select("part", "seq", "content").mapInArrow(read, "part int, seq int, doc_id long, own_start long, n_tokens long, ids_crc32 long, ids binary")
    return decoded.join(places, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    import public_tokenizers

    path = _base.new_path(spark, "token-files")
    write_token_files(_base.table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), path)
    return read_token_files(spark, path).drop("ids")
