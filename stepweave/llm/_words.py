"""Vectorised word and n-gram hashing over batches of texts (numpy only).

Texts are handled in chunks of a bounded number of bytes, a text that is longer
than a chunk alone in its own, so memory follows the longest text and not the
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch that become Python objects at a time.
ROWS_AT_ONCE = 2048
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LENGTH_KEY = np.uint64(0xD6E8FEB86659FD93)

#: Space, tab, line feed, vertical tab, form feed and carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    up, down = _powers["up"], _powers["down"]
    if len(up) > 1 << 23:  # made for one very long text
        _powers.clear()
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each (s, e): one prefix sum for all of them."""
    n = len(values)
    up, down = _power_table(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    weighted = values.astype(np.uint64)
    weighted += np.uint64(1)
    weighted *= up[:n]
    np.cumsum(weighted, out=total[1:])
    hashed = (total[ends] - total[starts]) * down[starts]
    hashed ^= (ends - starts).astype(np.uint64) * _LENGTH_KEY
    return mix(hashed)


class Chunk:
    """Words of consecutive texts: word i is data[start[i]:end[i]], those of text d are first[d] to first[d + 1]."""

    def __init__(self, raw: list[bytes]):
        joined = b"\n" + b"\n".join(raw) + b"\n"
        self.raw = raw
        self.data = np.frombuffer(joined, np.uint8)
        space = _SPACE[self.data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        self.text_start = np.cumsum([1] + [len(x) + 1 for x in raw])
        self.first = np.searchsorted(self.start, self.text_start)

    def hashes(self) -> np.ndarray:
        return segment_hashes(self.data, self.start, self.end)

    def single_spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each begins and ends in that."""
        keep = ~_SPACE[self.data]
        keep[self.end] = True
        data = self.data[keep]
        start = np.cumsum(self.end - self.start + 1) - (self.end - self.start + 1)
        end = start + self.end - self.start
        data[end] = 32
        return data.tobytes(), start, end


def windows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of all runs of n words inside one text, and the text of each."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    at = np.arange(len(owner)) - before[owner] + first[:-1][owner]
    return at, owner


def window_hashes(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return segment_hashes(words, at, at + n)


def rows_in_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[dict[str, list], list[bytes]]]:
    """Rows of the batches, regrouped so that the UTF-8 of a group's texts stays near the limit; null texts are empty."""
    for batch in (b.slice(low, ROWS_AT_ONCE) for b in batches for low in range(0, b.num_rows, ROWS_AT_ONCE)):
        columns = [c for c in batch.schema.names if c != text]
        raw = [b"" if x is None else x for x in batch.column(text).cast(pa.binary()).to_pylist()]
        others = {c: batch.column(c).to_pylist() for c in columns}
        low, size = 0, 0
        for i, x in enumerate(raw):
            if size and size + len(x) > limit:
                yield {c: v[low:i] for c, v in others.items()}, raw[low:i]
                low, size = i, 0
            size += len(x) + 1
        if raw:
            yield {c: v[low:] for c, v in others.items()}, raw[low:]
