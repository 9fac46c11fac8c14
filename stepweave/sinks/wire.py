"""Encoders for MessagePack and the Protocol Buffers wire format, as far as results need them."""

from __future__ import annotations

import struct
from collections.abc import Iterable


def msgpack(x: object) -> bytes:
    if x is None:
        return b"\xc0"
    if isinstance(x, bool):
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, int):
        if 0 <= x < 128:
            return bytes([x])
        if -32 <= x < 0:
            return bytes([256 + x])
        if x >= 0:
            return next(struct.pack(f, c, x) for f, c, top in ((">BB", 0xCC, 1 << 8), (">BH", 0xCD, 1 << 16), (">BI", 0xCE, 1 << 32), (">BQ", 0xCF, 1 << 64)) if x < top)
        return next(struct.pack(f, c, x) for f, c, low in ((">Bb", 0xD0, -(1 << 7)), (">Bh", 0xD1, -(1 << 15)), (">Bi", 0xD2, -(1 << 31)), (">Bq", 0xD3, -(1 << 63))) if x >= low)
    if isinstance(x, (str, bytes)):
        raw = x.encode() if isinstance(x, str) else x
        n = len(raw)
        head = bytes([0xA0 | n]) if n < 32 else struct.pack(">BB", 0xD9, n) if n < 1 << 8 else struct.pack(">BH", 0xDA, n) if n < 1 << 16 else struct.pack(">BI", 0xDB, n)
        return head + raw
    if isinstance(x, dict):
        n = len(x)
        head = bytes([0x80 | n]) if n < 16 else struct.pack(">BH", 0xDE, n) if n < 1 << 16 else struct.pack(">BI", 0xDF, n)
        return head + b"".join(msgpack(k) + msgpack(v) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        n = len(x)
        head = bytes([0x90 | n]) if n < 16 else struct.pack(">BH", 0xDC, n) if n < 1 << 16 else struct.pack(">BI", 0xDD, n)
        return head + b"".join(map(msgpack, x))
    raise TypeError(type(x).__name__)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def proto_bytes(number: int, raw: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def proto_int(number: int, n: int) -> bytes:
    return varint(number << 3) + varint(n) if n else b""


def proto_strings(number: int, values: Iterable[str]) -> bytes:
    return b"".join(proto_bytes(number, v.encode()) for v in values)
