"""HyperLogLog registers, bit by bit: hash, rank, hex form, merging and estimates.

The hash of a value is the low word of MurmurHash3 x64 128 with seed 0. The
register is chosen by the lowest ``precision`` bits; the rank is one more than
the leading zeros of the low 32 bits, of which the register bits count as set.

The hex form is precision and version (0 empty, 1 not) as two bytes, then runs
of (length, register value): a length under 128 takes one byte, others two,
of which the first has its highest bit set and the upper seven bits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np

PRECISION = 14
_M = (1 << 64) - 1


def _rotate(x: int, r: int) -> int:
    return (x << r | x >> 64 - r) & _M


def _scramble(k: int) -> int:
    k ^= k >> 33
    k = k * 0xFF51AFD7ED558CCD & _M
    k ^= k >> 33
    k = k * 0xC4CEB9FE1A85EC53 & _M
    return k ^ k >> 33


def murmur3_low(data: bytes, seed: int = 0) -> int:
    """The first 64 bits of MurmurHash3 x64 128."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    h1 = h2 = seed
    whole = len(data) // 16 * 16
    for i in range(0, whole, 16):
        k1, k2 = int.from_bytes(data[i : i + 8], "little"), int.from_bytes(data[i + 8 : i + 16], "little")
        h1 ^= _rotate(k1 * c1 & _M, 31) * c2 & _M
        h1 = ((_rotate(h1, 27) + h2) * 5 + 0x52DCE729) & _M
        h2 ^= _rotate(k2 * c2 & _M, 33) * c1 & _M
        h2 = ((_rotate(h2, 31) + h1) * 5 + 0x38495AB5) & _M
    tail = data[whole:]
    if len(tail) > 8:
        h2 ^= _rotate(int.from_bytes(tail[8:], "little") * c2 & _M, 33) * c1 & _M
    if tail:
        h1 ^= _rotate(int.from_bytes(tail[:8], "little") * c1 & _M, 31) * c2 & _M
    h1 ^= len(data)
    h2 ^= len(data)
    h1 = (h1 + h2) & _M
    h2 = (h2 + h1) & _M
    h1, h2 = _scramble(h1), _scramble(h2)
    return (h1 + h2) & _M


def encode_tuple(values: Iterable[str], raw: Iterable[bool]) -> bytes:
    """The tagged form of a value tuple: items begin with S, or B for raw bytes given in hex, and are parted by commas.

    A comma, a zero byte and a byte 0xff inside an item are 0xff and 0xfd, 0xfe or 0xff.
    """
    items = []
    for value, is_raw in zip(values, raw):
        data = bytes.fromhex(value) if is_raw and re.fullmatch("(?:[0-9a-f]{2})*", value) else value.encode()
        items.append((b"B" if is_raw else b"S") + data.replace(b"\xff", b"\xff\xff").replace(b",", b"\xff\xfd").replace(b"\0", b"\xff\xfe"))
    return b",".join(items)


def slot(text: str | bytes, precision: int = PRECISION) -> tuple[int, int]:
    """(register, rank) of a value."""
    h = murmur3_low(text.encode() if isinstance(text, str) else text)
    low = (1 << precision) - 1
    return h & low, 33 - ((h & 0xFFFFFFFF) | low).bit_length()


def to_hex(registers: dict[int, int] | np.ndarray, precision: int = PRECISION) -> str:
    full = np.zeros(1 << precision, np.uint8)
    if isinstance(registers, dict):
        for i, r in registers.items():
            full[i] = r
    else:
        full[:] = registers
    if not full.any():
        return f"{precision:02x}00"
    cuts = np.flatnonzero(np.r_[True, full[1:] != full[:-1], True])
    out = [precision, 1]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        while a < b:
            n = min(b - a, 0x7FFF)
            out += [n, int(full[a])] if n < 128 else [n & 0x7F | 0x80, n >> 7, int(full[a])]
            a += n
    return bytes(out).hex()


def from_hex(text: str) -> tuple[int, np.ndarray]:
    """(precision, registers)."""
    data = bytes.fromhex(text)
    if len(data) < 2 or data[1] > 1:
        raise ValueError("not a sketch")
    precision, values, at = data[0], [], 2
    while at < len(data):
        n = data[at]
        at += 1
        if n & 0x80:
            n = n & 0x7F | data[at] << 7
            at += 1
        values += [data[at]] * n
        at += 1
    registers = np.zeros(1 << precision, np.uint8)
    registers[: len(values)] = values
    return precision, registers


def merge(a: str, b: str) -> str:
    (p, x), (q, y) = from_hex(a), from_hex(b)
    if p != q:
        raise ValueError(f"sketches of precision {p} and {q} can't be merged")
    return to_hex(np.maximum(x, y), p)


def estimate(text: str) -> float:
    """The raw estimate, or linear counting where registers are empty and it is small."""
    precision, registers = from_hex(text)
    m = 1 << precision
    alpha = 0.7213 / (1 + 1.079 / m)
    raw = alpha * m * m / float(np.sum(np.exp2(-registers.astype(np.float64))))
    zeros = int((registers == 0).sum())
    return m * math.log(m / zeros) if raw <= 2.5 * m and zeros else raw
