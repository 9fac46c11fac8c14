"""Results as bytes: json, msgpack or proto.

msgpack. A counter is {"type": "int", "value"}; a set or multiset is {"type",
"data", "lexicon"}: values are cut after their first item, data has the ids of
the rest by first item (in multisets each id followed by its count), lexicon
the rest by id, nil where there is none; items in a rest are parted by a comma
and the item's type, and ids of histories are raw bytes where they come first.
Sketches are left out. With foreach, an array of {"result", "vars"}.

proto. Each result is preceded by its length as 64 little-endian bits. The
message is given by its .proto text; fields are found by name: scalar_x and
counter_x, set_x (repeated, values = 1), multiset_x (repeated, values = 1,
count = 2), hll_x (precision = 1, empty = 2, bins = 3), x in lower case.
"""

from __future__ import annotations

import json
import re
import struct

from ..dsl.program import Field, Program
from ..functions import hll
from ..operators.accumulate import Result
from ..operators.foreach import TUPLE
from .json_sink import as_json
from .wire import msgpack, proto_bytes, proto_int, proto_strings

_INTEGERS = ("int32", "int64", "uint32", "uint64", "sint32", "sint64", "fixed32", "fixed64")
_FIELD = re.compile(r"(?P<label>repeated\s+|optional\s+|required\s+)?(?P<type>[\w.]+)\s+(?P<name>\w+)\s*=\s*(?P<number>\d+)\s*(?:\[[^\]]*\])?\s*;")


def write_result(result: Result, format: str = "json", proto: str | None = None) -> bytes:
    if format == "json":
        return json.dumps(as_json(result), ensure_ascii=False).encode()
    rows = _rows(result)
    if format == "msgpack":
        objects = [{"result": _msgpack_object(result.program, values), "vars": variables} if result.per_tuple else _msgpack_object(result.program, values) for variables, values in rows]
        return msgpack(objects if result.per_tuple else objects[0])
    if format == "proto":
        if proto is None:
            raise ValueError("proto needs the text of the message's definition")
        fields = check_proto(result.program, proto, result.per_tuple)
        return b"".join(struct.pack("<Q", len(m)) + m for m in (_message(result.program, fields, *r) for r in rows))
    raise ValueError(f"No such format: {format}")


def _rows(result: Result) -> list[tuple[dict, dict]]:
    """(foreach variables, {result variable: {value tuple: n}}) for each tuple in order."""
    found: dict[int | None, dict] = {}
    for r in result.long().collect():
        found.setdefault(r[TUPLE], {}).setdefault(r["var"], {})[tuple(r["key"])] = r["n"]
    if not result.per_tuple:
        return [({}, found.get(None, {}))]
    tuples = result.tuples.df.orderBy(TUPLE).collect()
    return [({v: t[v] for v in result.tuples.variables}, found.get(t[TUPLE], {})) for t in tuples]


def _msgpack_object(program: Program, values: dict) -> dict:
    out = {}
    for name, kind in program.results.items():
        got = values.get(name, {})
        if kind == "counter":
            out[name] = {"type": "int", "value": sum(got.values())}
        elif kind != "hll":
            ids_first = any(y.target == name and isinstance(y.terms[0], Field) and y.terms[0].name == "cookie" for y in program.yields)
            data: dict[str | bytes, list[int]] = {}
            lexicon: dict[str | None, int] = {}
            for value in sorted(got):
                head: str | bytes = bytes.fromhex(value[0]) if ids_first and re.fullmatch("[0-9a-f]{32}", value[0]) else value[0]
                rest = ",S".join(value[1:]) if len(value) > 1 else None
                data.setdefault(head, []).append(lexicon.setdefault(rest, len(lexicon) + 1))
                if kind == "multiset":
                    data[head].append(got[value])
            out[name] = {"type": kind, "data": data, "lexicon": lexicon}
    return out


def check_proto(program: Program, text: str, per_tuple: bool) -> dict[str, int]:
    """Field numbers by name; raises where a result has no field, or one of another type or label."""
    text = re.sub(r"//.*|/\*.*?\*/", "", text, flags=re.S if "/*" in text else 0) if "/*" in text else re.sub(r"//.*", "", text)
    m = re.search(r"message\s+Result\s*\{(.*?)\}", text, re.S)
    if not m:
        raise ValueError("there is no message Result")
    there = {f["name"].lower(): f for f in _FIELD.finditer(m[1])}
    wanted = {_proto_name(v): k for v, k in program.results.items()}
    if per_tuple:
        wanted |= {_proto_name(v): "scalar" if v[0] == "%" else "strings" for v in program.bound}
    for name, kind in wanted.items():
        f = there.get(name)
        if f is None:
            raise ValueError(f"Result has no field {name}")
        type_, repeated = f["type"].rpartition(".")[2], (f["label"] or "").strip() == "repeated"
        fits = {"counter": type_ in _INTEGERS, "scalar": type_ == "string", "strings": type_ == "string", "set": type_ == "SetTuple", "multiset": type_ == "MultisetTuple", "hll": type_ == "Hll"}[kind]
        if not fits or repeated != (kind in ("set", "multiset", "strings")):
            raise ValueError(f"{name} can't be {f['label'] or ''}{f['type']}")
        if kind == "counter" and type_ not in ("int32", "int64", "uint32", "uint64"):
            raise ValueError(f"{name}: {type_} isn't supported; use a plain integer type")
    return {name: int(there[name]["number"]) for name in wanted}


def _proto_name(variable: str) -> str:
    return {"$": "counter_", "#": "set_", "&": "multiset_", "^": "hll_", "%": "scalar_"}[variable[0]] + variable[1:].lower()


def _message(program: Program, fields: dict[str, int], variables: dict, values: dict) -> bytes:
    parts = []
    for v, x in variables.items():
        parts.append(proto_bytes(fields[_proto_name(v)], x.encode()) if isinstance(x, str) else proto_strings(fields[_proto_name(v)], x))
    for v, kind in program.results.items():
        number, got = fields[_proto_name(v)], values.get(v, {})
        if kind == "counter":
            parts.append(proto_int(number, sum(got.values())))
        elif kind in ("set", "multiset"):
            parts += [proto_bytes(number, proto_strings(1, value) + (proto_int(2, got[value]) if kind == "multiset" else b"")) for value in sorted(got)]
        else:
            text = hll.to_hex({int(k[0]): n for k, n in got.items()})
            parts.append(proto_bytes(number, proto_int(1, hll.PRECISION) + (proto_bytes(3, text[4:].encode()) if got else proto_int(2, 1))))
    return b"".join(parts)
