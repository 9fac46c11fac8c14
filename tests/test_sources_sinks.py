import json
import struct

import numpy as np
import pytest

from stepweave import EventSource, histories_from_json, lexicon, read_excludes, read_params, read_windows, run
from stepweave.functions import hll
from stepweave.sinks import as_json, extract_histories, histories_json, json_rows, write_result
from stepweave.sinks.wire import msgpack, varint

TRAILS = [{"ab": [{"timestamp": 1, "type": "x", "k": "1"}, {"timestamp": 2, "type": "y"}], "cd": [{"timestamp": 3, "type": "x", "k": "2"}]}, {"ab": [{"timestamp": 9, "other": "q"}]}]
AB, CD = "ab".encode().hex().ljust(32, "0"), "cd".encode().hex().ljust(32, "0")


def test_histories(spark):
    sources = histories_from_json(spark, TRAILS)
    rows = extract_histories(sources, [AB]).orderBy("source", "ts").collect()
    assert [(r["id"], r["source"], r["ts"], r["type"], r["k"], r["other"]) for r in rows] == [(AB, 0, 1, "x", "1", ""), (AB, 0, 2, "y", "", ""), (AB, 1, 9, "", "", "q")]
    assert extract_histories(sources, spark.createDataFrame([(CD,)], "id string")).count() == 1
    assert extract_histories(sources, None, {"clauses": [[{"field": "type", "value": "x"}]]}).count() == 2
    got = {(r["source"], k): v for r in histories_json(sources).collect() for k, v in json.loads(r["json"]).items()}
    assert got[0, AB] == [{"timestamp": 1, "k": "1", "type": "x", "other": ""}, {"timestamp": 2, "k": "", "type": "y", "other": ""}]
    assert set(got) == {(0, AB), (0, CD), (1, AB)}
    with pytest.raises(ValueError, match="time goes back"):
        histories_from_json(spark, [{"a": [{"timestamp": 2}, {"timestamp": 1}]}])
    with pytest.raises(ValueError, match="16 bytes"):
        histories_from_json(spark, [{"a" * 17: [{"timestamp": 2}]}])


def test_lexicon(spark):
    sources = histories_from_json(spark, TRAILS)
    assert {r[0] for r in lexicon(sources, "k").collect()} == {"", "1", "2"}
    with pytest.raises(ValueError, match="No source"):
        lexicon(sources, "nosuch")


def test_side_files(spark, tmp_path):
    (tmp_path / "w.csv").write_text(f"{AB},1,2\n{CD},0,0\n")
    assert [tuple(r) for r in read_windows(spark, str(tmp_path / "w.csv")).orderBy("_id").collect()] == [(AB, 1, 2), (CD, 0, 0)]
    (tmp_path / "v.csv").write_text(f"{AB},1,2,p\n{AB},3,4,q\n")
    assert read_windows(spark, str(tmp_path / "v.csv")).count() == 2
    (tmp_path / "u.csv").write_text(f"{AB},1,2\n{AB},3,4\n")
    with pytest.raises(ValueError, match="twice"):
        read_windows(spark, str(tmp_path / "u.csv"))
    (tmp_path / "e.txt").write_text(f"{AB}\n{CD}\n")
    assert read_excludes(spark, str(tmp_path / "e.txt")).count() == 2
    (tmp_path / "f.txt").write_text("xyz\n")
    with pytest.raises(ValueError, match="not an id"):
        read_excludes(spark, str(tmp_path / "f.txt"))
    (tmp_path / "p.json").write_text('{"%x": "1", "@a": [["b", ["c"]]]}')
    assert read_params(str(tmp_path / "p.json"))["@a"] == [["b", ["c"]]]


def test_windows_with_ids(spark):
    text = "a ->\n    receive\n        type = 'x' -> yield cookie,cookie_timestamp_filter_start to &s\n        * -> repeat"
    w = spark.createDataFrame([(AB, 0, 2, "p"), (AB, 1, 0, "q"), ("none", 0, 0, "r")], "_id string, start long, end long, window_id string")
    for plan in ("stateless", "matcher"):
        assert as_json(run(text, histories_from_json(spark, TRAILS), windows=w, plan=plan)) == {"&s": {"p,0": 1, "q,1": 1}}


PROGRAM = "foreach %t in @z\n    a ->\n        receive\n            type = %t -> yield $n, yield cookie,k to #s, yield k to &m, yield k to ^h\n            * -> repeat"
PROTO = """
syntax = "proto3";
message Result { // comment = 9;
  string scalar_t = 1;
  uint64 counter_n = 2;
  repeated x.SetTuple set_s = 3;
  repeated x.MultisetTuple multiset_m = 4;
  x.Hll hll_h = 5;
  string extra = 6;
}
"""


def test_json(spark):
    r = run(PROGRAM, histories_from_json(spark, TRAILS[:1]), {"@z": [["x"], ["none"]]})
    objects = as_json(r)
    assert list(objects[0]) == ["$n", "#s", "&m", "^h", "%t"]
    assert objects[0]["$n"] == 2 and objects[0]["#s"] == [f"{AB},1", f"{CD},2"] and objects[0]["&m"] == {"1": 1, "2": 1}
    assert objects[1] == {"$n": 0, "#s": [], "&m": {}, "^h": "0e00", "%t": "none"}
    assert json.loads(write_result(r)) == objects
    assert sorted(json.loads(x[0])["$n"] for x in json_rows(r).collect()) == [0, 2]


def test_msgpack(spark):
    r = run(PROGRAM, histories_from_json(spark, TRAILS[:1]), {"@z": [["x"]]})
    want = [{"result": {"$n": {"type": "int", "value": 2}, "#s": {"type": "set", "data": {bytes.fromhex(AB): [1], bytes.fromhex(CD): [2]}, "lexicon": {"1": 1, "2": 2}}, "&m": {"type": "multiset", "data": {"1": [1, 1], "2": [1, 1]}, "lexicon": {None: 1}}}, "vars": {"%t": "x"}}]
    assert write_result(r, "msgpack") == msgpack(want)


def test_msgpack_encoding():
    assert msgpack([None, True, 1, 200, 70000, 1 << 40, -1, -200, -(1 << 40), "a"]).hex() == "9ac0c301ccc8ce00011170cf0000010000000000ffd1ff38d3ffffff0000000000a161"
    assert msgpack("a" * 40)[:2] == b"\xd9\x28" and msgpack({i: i for i in range(16)})[:3] == b"\xde\x00\x10"


def read_proto(raw):
    out, at = [], 0

    def number():
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(raw):
        tag = number()
        if tag & 7 == 2:
            n = number()
            out.append((tag >> 3, raw[at : at + n]))
            at += n
        else:
            out.append((tag >> 3, number()))
    return out


def test_proto(spark):
    r = run(PROGRAM, histories_from_json(spark, TRAILS[:1]), {"@z": [["x"], ["none"]]})
    data = write_result(r, "proto", PROTO)
    (n,) = struct.unpack_from("<Q", data)
    first = read_proto(data[8 : 8 + n])
    assert first[0] == (1, b"x") and first[1] == (2, 2)
    assert [read_proto(v) for k, v in first if k == 3] == [[(1, AB.encode()), (1, b"1")], [(1, CD.encode()), (1, b"2")]]
    assert [read_proto(v) for k, v in first if k == 4] == [[(1, b"1"), (2, 1)], [(1, b"2"), (2, 1)]]
    (sketch,) = [dict(read_proto(v)) for k, v in first if k == 5]
    assert sketch[1] == 14 and hll.from_hex("0e01" + sketch[3].decode())[1].astype(bool).sum() == 2
    second = read_proto(data[16 + n :])
    assert second[0] == (1, b"none") and dict(read_proto(dict(second)[5])) == {1: 14, 2: 1}
    for old, new in (("uint64 counter_n", "string counter_n"), ("repeated x.SetTuple", "x.SetTuple"), ("string scalar_t", "string other")):
        with pytest.raises(ValueError):
            write_result(r, "proto", PROTO.replace(old, new))


def test_single_result_as_proto(spark):
    r = run("a ->\n    receive\n        * -> yield $n", histories_from_json(spark, TRAILS[:1]))
    assert write_result(r, "proto", "message Result { int64 counter_n = 1; }") == struct.pack("<Q", 2) + b"\x08\x03"
    assert varint(300) == b"\xac\x02"


def test_sketch_forms():
    rng = np.random.default_rng(5)
    registers = {int(i): int(r) for i, r in zip(rng.choice(1 << 14, 900, replace=False), rng.integers(1, 19, 900))}
    text = hll.to_hex(registers)
    precision, full = hll.from_hex(text)
    assert precision == 14 and {int(i): int(full[i]) for i in np.flatnonzero(full)} == registers
    assert hll.merge(text, "0e00") == text and hll.merge(hll.to_hex({3: 1, 4: 7}), hll.to_hex({3: 2})) == hll.to_hex({3: 2, 4: 7})
    assert hll.to_hex({}) == "0e00"
    with pytest.raises(ValueError):
        hll.merge("0e00", "0f00")
    full = {}
    for i in range(20_000):
        at, rank = hll.slot(str(i))
        full[at] = max(full.get(at, 0), rank)
    assert abs(hll.estimate(hll.to_hex(full)) - 20_000) < 600
    assert hll.estimate("0e00") == 0


def test_murmur_known_values():
    # published test values of MurmurHash3 x64 128, first word
    assert hll.murmur3_low(b"") == 0
    assert f"{hll.murmur3_low(b'The quick brown fox jumps over the lazy dog'):016x}" == "e34bbc7bbc071b6c"


def test_sources_declared_distinct_read_only_what_they_need(spark, sf_dir):
    from stepweave.queries import COUNT_CLICKS, events

    r = run(COUNT_CLICKS, events(spark, sf_dir))
    plan = r.partial._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1] and "Python" not in plan
    assert "PushedFilters: [EqualNullSafe(event_type,click)]" in plan or "event_type" in plan.split("PushedFilters")[1][:80]
    assert "props" not in plan.split("ReadSchema")[1]


def test_events_of_equal_time_keep_their_order(spark):
    df = spark.createDataFrame([("u", 5, i, t) for i, t in enumerate("abab")], "id string, ts long, seq long, type string")
    text = "a ->\n    receive\n        type = 'a' -> b\n        * -> repeat\nb ->\n    receive\n        type = 'b' -> yield $n, a\n        * -> repeat"
    assert as_json(run(text, EventSource(df, "id", "ts", {"type": "type"}, ("seq",)))) == {"$n": 2}
