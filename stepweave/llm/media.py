"""ISO base media containers in a binary column: writing, and probing without decoding.

The probe walks the nested boxes of a file, decodes the sample tables (stts,
stss, stsz or stz2, stsc, stco or co64) and those of fragments (trex, tfhd,
trun), and gives for each track codec, duration and the byte ranges of
keyframes; the media payload is never looked into.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import _base, _words

SAMPLE_BYTES = 192
SAMPLES_PER_CHUNK = 32
KEYFRAME_EVERY = 8
TIMESCALE = 8000
CODEC = "raw "
_CONTAINERS = {b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}
#: No box that is looked for lies deeper.
_DEPTH = 8
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class MediaError(ValueError):
    """The bytes are no whole ISO media file."""


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return head + b"".join(parts)


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, b"\0\0\0\0", *parts)


def write_media(payload: bytes, sample_bytes: int = SAMPLE_BYTES, samples_per_chunk: int = SAMPLES_PER_CHUNK, keyframe_every: int = KEYFRAME_EVERY, timescale: int = TIMESCALE) -> bytes:
    """One audio track of unsigned 8-bit samples; an access unit holds sample_bytes of them, the last what is left."""
    n = -(-len(payload) // sample_bytes)
    chunks = -(-n // samples_per_chunk)
    last = len(payload) - (n - 1) * sample_bytes if n else sample_bytes
    even = last == sample_bytes
    sizes = struct.pack(">II", sample_bytes, n) if even else struct.pack(">II", 0, n) + np.array([sample_bytes] * (n - 1) + [last], ">u4").tobytes()
    times = [(n, sample_bytes)] if even and n else [x for x in ((n - 1, sample_bytes), (1, last)) if x[0] > 0] if n else []
    runs = [x for x in ((1, min(n, samples_per_chunk)),) if n]
    if chunks > 1 and n % samples_per_chunk:
        runs.append((chunks, n % samples_per_chunk))
    keys = np.arange(1, n + 1, keyframe_every)
    wide = len(payload) >= (1 << 32) - (1 << 24)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = _box(CODEC.encode(), b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, timescale << 16 & 0xFFFFFFFF))

    def moov(base: int) -> bytes:
        offsets = base + np.arange(chunks, dtype=np.int64) * (samples_per_chunk * sample_bytes)
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">I", len(times)), b"".join(struct.pack(">II", *x) for x in times)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *x, 1) for x in runs)),
            _full(b"stsz", sizes),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        length = len(payload)
        info = _box(b"minf", _full(b"smhd", b"\0" * 4), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1"))), table)
        media = _box(b"mdia", _clock(b"mdhd", timescale, length, struct.pack(">HH", 0x55C4, 0)), _full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"\0"), info)
        track = struct.pack(">IIIII", 0, 0, 1, 0, min(length, 0xFFFFFFFF)) + b"\0" * 8 + struct.pack(">hhhH", 0, 0, 256, 0) + _MATRIX + b"\0" * 8
        movie = struct.pack(">IH", 0x10000, 256) + b"\0" * 10 + _MATRIX + b"\0" * 24 + struct.pack(">I", 2)
        return _box(b"moov", _clock(b"mvhd", timescale, length, movie), _box(b"trak", _full(b"tkhd", track), media))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    return ftyp + moov(len(ftyp) + len(moov(0)) + head) + _box(b"mdat", payload)


def _clock(kind: bytes, timescale: int, duration: int, rest: bytes) -> bytes:
    if duration >= 1 << 32:
        return _box(kind, b"\1\0\0\0", struct.pack(">QQIQ", 0, 0, timescale, duration), rest)
    return _full(kind, struct.pack(">IIII", 0, 0, timescale, duration), rest)


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, where the content begins, where it ends) of the boxes side by side in data[start:end]."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise MediaError(f"{end - start} bytes are left at {start}, too few for a box")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise MediaError(f"a box at {start} is cut off")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise MediaError(f"a box at {start} claims {size} bytes of {end - start}")
        yield kind, start + head, start + size
        start += size


def _tree(data: bytes, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    for kind, a, b in boxes(data, start, end):
        yield (*path, kind), a, b
        if kind in _CONTAINERS and len(path) < _DEPTH:
            yield from _tree(data, a, b, (*path, kind))


@dataclass(frozen=True)
class Track:
    track_id: int
    codec: str
    handler: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keyframes: np.ndarray

    def payload(self, data: bytes) -> bytes:
        """All samples in order, as stored."""
        if not len(self.sizes):
            return b""
        ends = self.offsets + self.sizes
        if (self.offsets[1:] == ends[:-1]).all():
            return data[int(self.offsets[0]) : int(ends[-1])]
        return b"".join(data[a:b] for a, b in zip(self.offsets.tolist(), ends.tolist()))


def _table(data: bytes, a: int, b: int, kind: str, columns: int) -> np.ndarray:
    """Rows of a full box that begins with their number."""
    if b - a < 8:
        raise MediaError("a table is cut off")
    (n,) = struct.unpack_from(">I", data, a + 4)
    if a + 8 + n * columns * np.dtype(kind).itemsize > b:
        raise MediaError(f"a table claims {n} rows, more than its box holds")
    return np.frombuffer(data, kind, n * columns, a + 8).astype(np.int64).reshape(n, columns)


def _numbers(data: bytes, end: int, layout: str, at: int) -> tuple[int, ...]:
    if at + struct.calcsize(layout) > end:
        raise MediaError(f"a box is cut off at {at}")
    return struct.unpack_from(layout, data, at)


def probe_media(data: bytes) -> list[Track]:
    """The tracks of a file; raises MediaError where it isn't whole. A track without stss has key samples only."""
    try:
        return _probe(data)
    except (struct.error, IndexError, ValueError, OverflowError) as e:
        raise e if isinstance(e, MediaError) else MediaError(str(e)) from e


def _probe(data: bytes) -> list[Track]:
    top = list(boxes(data))
    tracks: dict[int, Track] = {}
    defaults: dict[int, tuple[int, ...]] = {}
    fragments = [(a, b) for kind, a, b in top if kind == b"moof"]
    for kind, a, b in top:
        if kind != b"moov":
            continue
        for inner, c, d in boxes(data, a, b):
            if inner == b"trak":
                track = _track(data, c, d)
                if track.track_id in tracks:
                    raise MediaError(f"two tracks of id {track.track_id}")
                tracks[track.track_id] = track
            elif inner == b"mvex":
                for k, x, y in boxes(data, c, d):
                    if k == b"trex":
                        track_id, *rest = _numbers(data, y, ">5I", x + 4)
                        defaults[track_id] = tuple(rest[1:])
    if not any(k == b"moov" for k, _, _ in top):
        raise MediaError("no moov box")
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]] = {}
    for a, b in fragments:
        _fragment(data, a, b, defaults, found)
    for track_id, runs in found.items():
        if track_id not in tracks:
            raise MediaError(f"a fragment of track {track_id}, which isn't there")
        t = tracks[track_id]
        before = np.cumsum([len(t.sizes)] + [len(r[0]) for r in runs])
        offsets, sizes = (np.concatenate([own, *(r[k] for r in runs)]) for k, own in enumerate((t.offsets, t.sizes)))
        keys = np.concatenate([t.keyframes, *(r[2] + n for r, n in zip(runs, before))])
        duration = (t.duration if len(t.sizes) else 0) + sum(r[3] for r in runs)
        tracks[track_id] = Track(track_id, t.codec, t.handler, t.timescale, duration, offsets, sizes, keys)
    return list(tracks.values())


def _fragment(data: bytes, start: int, end: int, defaults: dict[int, tuple[int, ...]], found: dict[int, list]) -> None:
    """Adds (offsets, sizes, key samples, duration) of each run of samples; offsets count from the moof box."""
    moof = start - 8 if data[start - 4 : start] == b"moof" else start - 16
    for kind, a, b in boxes(data, start, end):
        if kind != b"traf":
            continue
        inner = list(boxes(data, a, b))
        head = next(((x, y) for k, x, y in inner if k == b"tfhd"), None)
        if head is None:
            raise MediaError("a fragment without tfhd")
        flags, track_id = _numbers(data, head[1], ">II", head[0])
        at, base = head[0] + 8, moof
        if flags & 1:
            (base,), at = _numbers(data, head[1], ">Q", at), at + 8
        at += 4 * bool(flags & 2)
        own = list(defaults.get(track_id, (0, 0, 0)))
        for k, flag in enumerate((8, 16, 32)):
            if flags & flag:
                (own[k],), at = _numbers(data, head[1], ">I", at), at + 4
        next_byte = base
        for k, x, y in inner:
            if k != b"trun":
                continue
            flags, n = _numbers(data, y, ">II", x)
            flags &= 0xFFFFFF
            at, first_flags = x + 8, None
            if flags & 1:
                (shift,), at = _numbers(data, y, ">i", at), at + 4
                next_byte = base + shift
            if flags & 4:
                (first_flags,), at = _numbers(data, y, ">I", at), at + 4
            there = [c for c, flag in enumerate((0x100, 0x200, 0x400, 0x800)) if flags & flag]
            if at + 4 * n * len(there) > y or n > len(data):
                raise MediaError(f"trun claims {n} samples, more than its box or the file holds")
            rows = np.frombuffer(data, ">u4", n * len(there), at).astype(np.int64).reshape(n, len(there))
            column = lambda c, default: rows[:, there.index(c)] if c in there else np.full(n, default, np.int64)  # noqa: E731, B023
            durations, sizes, marks = column(0, own[0]), column(1, own[1]), column(2, own[2]).copy()
            if first_flags is not None and n:
                marks[0] = first_flags
            offsets = next_byte + np.cumsum(sizes) - sizes
            if n and (offsets[0] < 0 or offsets[-1] + sizes[-1] > len(data)):
                raise MediaError("samples of a fragment lie beyond the file's end")
            next_byte += int(sizes.sum())
            found.setdefault(track_id, []).append((offsets, sizes, np.flatnonzero(marks & 0x10000 == 0), int(durations.sum())))


def _sample_sizes(data: bytes, at: dict[bytes, tuple[int, int]]) -> tuple[int, np.ndarray | int]:
    """The number of samples, and the size of each or of all."""
    if b"stsz" in at:
        a, b = at[b"stsz"]
        uniform, n = _numbers(data, b, ">II", a + 4)
        if uniform:
            return n, uniform
        if a + 12 + 4 * n > b:
            raise MediaError(f"stsz claims {n} samples")
        return n, np.frombuffer(data, ">u4", n, a + 12).astype(np.int64)
    a, b = at[b"stz2"]
    width, n = _numbers(data, b, ">II", a + 4)
    width &= 0xFF
    if width not in (4, 8, 16) or a + 12 + (n * width + 7) // 8 > b:
        raise MediaError(f"stz2 claims {n} samples of {width} bits")
    if width == 4:
        pairs = np.frombuffer(data, np.uint8, (n + 1) // 2, a + 12)
        return n, np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:n].astype(np.int64)
    return n, np.frombuffer(data, f">u{width // 8}", n, a + 12).astype(np.int64)


def _track(data: bytes, start: int, end: int) -> Track:
    at = {path[-1]: (a, b) for path, a, b in _tree(data, start, end)}
    missing = [k.decode() for k in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc") if k not in at]
    if missing or not (b"stco" in at or b"co64" in at) or not (b"stsz" in at or b"stz2" in at):
        raise MediaError(f"a track without {', '.join(missing) or 'chunk offsets or sample sizes'}")
    a, b = at[b"mdhd"]
    (version,) = _numbers(data, b, ">B", a)
    timescale, duration = _numbers(data, b, ">IQ", a + 20) if version == 1 else _numbers(data, b, ">II", a + 12)
    a, b = at[b"hdlr"]
    handler = _numbers(data, b, ">4s", a + 8)[0].decode("latin-1")
    track_id = 0
    if b"tkhd" in at:
        a, b = at[b"tkhd"]
        track_id = _numbers(data, b, ">I", a + (20 if _numbers(data, b, ">B", a)[0] == 1 else 12))[0]
    entries = list(boxes(data, at[b"stsd"][0] + 8, at[b"stsd"][1]))
    codec = entries[0][0].decode("latin-1") if entries else ""
    n, sizes = _sample_sizes(data, at)
    chunk = _table(data, *at[b"co64"], ">u8", 1)[:, 0] if b"co64" in at else _table(data, *at[b"stco"], ">u4", 1)[:, 0]
    runs = _table(data, *at[b"stsc"], ">u4", 3)
    per_chunk = np.zeros(len(chunk), np.int64)
    firsts = runs[:, 0].tolist()
    if firsts and (firsts[0] != 1 or any(x >= y for x, y in zip(firsts, firsts[1:]))):
        raise MediaError("stsc isn't in order")
    for (first, many, _), after in zip(runs.tolist(), [*firsts[1:], len(chunk) + 1]):
        per_chunk[first - 1 : after - 1] = many
    # Counts are checked before anything of their size is made.
    if per_chunk.sum() != n or n > len(data):
        raise MediaError(f"chunks hold {per_chunk.sum()} samples, {n} are claimed, in {len(data)} bytes")
    if isinstance(sizes, int):
        sizes = np.full(n, sizes, np.int64)
    owner = np.repeat(np.arange(len(chunk)), per_chunk)
    before = np.r_[0, np.cumsum(sizes)]
    begins = np.cumsum(per_chunk) - per_chunk
    offsets = chunk[owner] + before[:-1] - before[begins[owner]] if n else np.zeros(0, np.int64)
    if n and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise MediaError("samples lie beyond the file's end")
    times = _table(data, *at[b"stts"], ">u4", 2)
    if times.size and times[:, 0].sum() == n:
        duration = int((times[:, 0] * times[:, 1]).sum())
    keys = _table(data, *at[b"stss"], ">u4", 1)[:, 0] - 1 if b"stss" in at else np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise MediaError("stss names a sample that isn't there")
    return Track(track_id, codec, handler, int(timescale), int(duration), offsets, sizes, keys)


_RANGES = T.ArrayType(T.StructType().add("start", "long").add("size", "long"))


_TRACK = T.StructType().add("track_id", "long").add("handler", "string").add("codec", "string").add("timescale", "long").add("duration", "long").add("n_samples", "long").add("keyframes", _RANGES)
_RANGE_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
_TRACK_TYPE = pa.struct([("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", _RANGE_TYPE)])


def with_probe(df: DataFrame, media: str = "media", output: list[str] | None = None) -> DataFrame:
    """Adds tracks (one entry for each: track_id, handler, codec, timescale, duration, n_samples, keyframes as byte ranges), the same of the first one as columns codec, timescale, duration, n_samples and keyframes, and media_error.

    Null media give nulls; bytes that are no whole file, of whatever kind, give
    nulls and the reason in media_error; a file without tracks has codec null,
    no samples and no entry in tracks. ``output`` names the columns to keep (all
    by default, without the added names). Rows stay in number and place; an
    empty table gives an empty result.
    """
    _base.require(df, media)
    added = T.StructType().add("codec", "string").add("timescale", "long").add("duration", "long").add("n_samples", "long").add("keyframes", _RANGES).add("tracks", T.ArrayType(_TRACK)).add("media_error", "string")
    kept = [c for c in (df.columns if output is None else output) if c not in added.names]
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), _RANGE_TYPE, pa.list_(_TRACK_TYPE), pa.string())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_describe(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=schema.names)

    return df.select(*kept, df[media].alias(_base.fresh(df, "its_media"))).mapInArrow(probe, schema)


def _key_ranges(t: Track) -> list[dict]:
    return [{"start": a, "size": n} for a, n in zip(t.offsets[t.keyframes].tolist(), t.sizes[t.keyframes].tolist())]


def _describe(data: bytes | None) -> tuple:
    if data is None:
        return (None,) * 7
    try:
        tracks = probe_media(data)
    except MediaError as e:
        return (None,) * 6 + (str(e),)
    if not tracks:
        return None, None, None, 0, [], [], None
    each = [{"track_id": t.track_id, "handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes), "keyframes": _key_ranges(t)} for t in tracks]
    return (*(each[0][c] for c in ("codec", "timescale", "duration", "n_samples", "keyframes")), each, None)


def media_of_texts(docs: DataFrame, text: str = "text", unit: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, n_bytes, media: the UTF-8 of each text (null: none), filled up with spaces to a positive multiple of ``unit``, as a media file."""
    _base.require(docs, "doc_id", text)
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("media", "binary")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns, raw in _words.rows_in_chunks(iter([batch])):
                padded = [x + b" " * (max(1, -(-len(x) // unit)) * unit - len(x)) for x in raw]
                yield pa.RecordBatch.from_arrays([pa.array(columns["doc_id"], batch.schema.field("doc_id").type), pa.array([len(x) for x in raw], pa.int64()), pa.array(list(map(write_media, padded)), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(write, schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, keyframes, all from the stored files.

    The files are written as a table in the shared folder and read back.
    """
    path = _base.new_path(spark, "media")
    media_of_texts(_base.table(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(path)
    media = spark.read.parquet(path)
    schema = media.select("doc_id", "n_bytes").schema
    for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(name, kind)
    schema = schema.add("keyframes", _RANGES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                (track,) = probe_media(data)
                payload = track.payload(data)
                starts, sizes = track.offsets[track.keyframes], track.sizes[track.keyframes]
                ranges = zlib.crc32(np.stack([starts, sizes], axis=1).astype("<i8").tobytes())
                feature = f"codec={track.codec.strip()};duration={track.duration}/{track.timescale};samples={len(track.sizes)};keyframes={len(starts)};ranges={ranges:08x}"
                key = [{"start": a, "size": n} for a, n in zip(starts.tolist(), sizes.tolist())]
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, key))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=schema.names)

    return media.mapInArrow(read, schema)
