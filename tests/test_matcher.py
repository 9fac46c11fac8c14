"""The machine's rules, on histories small enough to follow by hand."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepweave import Functions, from_ir, histories_from_json, parse, run
from stepweave.functions.hll import encode_tuple, slot
from stepweave.plans.machine import END_TS, Machine, Matcher, NonExhaustive, Tuples
from stepweave.sinks import as_json


def play(text, events, params=None, tuples=None, functions=None, **flags):
    """Counts by (tuple, variable, value) of one history of (ts, type[, k])."""
    p = text if not isinstance(text, str) else parse(text)
    fields = p.fields
    free = [frozenset(params[v]) if v[0] == "#" else params[v] for v in p.free]
    m = Matcher(Machine(p, fields, functions or {}, **flags), free, None if tuples is None else Tuples(p, tuples), False, len(fields))
    for e in events:
        row = dict(zip(("type", "k"), (*e[1:], "")))
        m.feed("h", 0, e[0], 0, 0, tuple(row.get(f, "") for f in fields))
    m.close()
    out = {}
    for t, var, value, n in m.drain():
        key = (var, value) if tuples is None else (t, var, value)
        out[key if value else key[:-1]] = n
    return out if tuples is not None else {k[0] if len(k) == 1 else k: n for k, n in out.items()}


SKIP = "a ->\n    receive\n        type = 'c' -> yield $n, skip\n        * -> repeat\nskip ->\n    receive\n        * -> repeat\n    after 10s -> a"


def test_timeout_reexamines_the_event():
    assert play(SKIP, [(0, "c"), (9, "c"), (10, "c"), (15, "c"), (100, "x")]) == {"$n": 2}


def test_block_entered_by_timeout_starts_when_it_ran_out():
    text = "a ->\n    receive\n        * -> b\nb ->\n    receive\n        * -> repeat\n    after 10s -> c\nc ->\n    receive\n        * -> yield $in, repeat\n    after 10s -> yield $out, a"
    assert play(text, [(0, "x"), (15, "x")]) == {"$in": 1, "$out": 1}
    # c lasts from 10 to 20, so the late event ends it at once and starts again at a
    assert play(text, [(0, "x"), (25, "x"), (26, "y")]) == {"$out": 1}


def test_only_one_timeout_fires_at_the_end():
    text = "a ->\n    receive\n        * -> b\nb ->\n    receive\n        * -> repeat\n    after 10s -> yield $b, c\nc ->\n    receive\n        * -> repeat\n    after 10s -> yield $c, a"
    assert play(text, [(0, "x")]) == {"$b": 1}


def test_timeout_without_duration_fires_at_the_end_only():
    text = "a ->\n    receive\n        type = 'x' -> b\n        * -> repeat\nb ->\n    receive\n        * -> repeat\n    after -> yield $open, yield type,timestamp,cookie_timestamp_filter_end to #s, a"
    assert play(text, [(0, "x"), (10**12, "y")]) == {"$open": 1, ("#s", ("", str(END_TS), "0")): 1}
    assert play(text, [(0, "y")]) == {}


def test_entry_block_has_no_window_at_first():
    text = "a ->\n    receive\n        type = 'x' -> a\n        * -> yield $n\n    after 5s -> yield $late, b\nb ->\n    receive\n        * -> repeat"
    assert play(text, [(0, "y"), (100, "y")]) == {"$n": 2}
    assert play(text, [(0, "x"), (100, "y")]) == {"$late": 1}


NESTED = "a ->\n    receive\n        type = 's' -> w\n        * -> repeat\nw ->\n    window\n        i ->\n            receive\n                type = 'x' -> yield $x, yield start_timestamp[w] to &at, repeat\n                * -> repeat\n    after 10s -> yield $w, a"


def test_outer_window():
    events = [(5, "s"), (6, "x"), (50, "x"), (60, "y")]
    # the block inside never runs out, so the window is looked at only at the end
    assert play(NESTED, events) == {"$x": 2, ("&at", ("5",)): 2, "$w": 1}
    assert play(NESTED, events, eager_outer_expiry=True) == {"$x": 1, ("&at", ("5",)): 1, "$w": 1}


def test_outermost_window_goes_first_and_leaving_drops_windows():
    text = "a ->\n    receive\n        * -> w\nw ->\n    window\n        v ->\n            window\n                i ->\n                    receive\n                        type = 'q' -> a\n                        * -> repeat\n                    after 3s -> yield $i, i\n            after 5s -> yield $v, a\n    after 5s -> yield $w, a"
    assert play(text, [(0, "x"), (20, "x")]) == {"$w": 2}
    assert play(text, [(0, "x"), (1, "q")]) == {}
    assert play(text, [(0, "x"), (4, "y")])["$i"] == 1


def test_start_timestamp():
    text = "a ->\n    receive\n        type = 's' -> b\n        * -> repeat\nb ->\n    receive\n        * -> yield start_timestamp,timestamp to &s, a\n    after 10s -> a"
    assert play(text, [(3, "s"), (7, "x")]) == {("&s", ("3", "7")): 1}


def test_entry_window_starts_with_the_first_event():
    text = "w ->\n    window\n        a ->\n            receive\n                * -> yield start_timestamp[w] to &s, repeat\n    after 50s -> quit"
    assert play(text, [(7, "x"), (9, "x")]) == {("&s", ("7",)): 2}


def test_json_moves():
    p = from_ir({"rules": [{"clauses": [{"attrs": {"type": ["x"]}, "action": "break"}, {"attrs": {}, "action": "repeat"}]}, {"window": 1000, "clauses": [{"attrs": {"type": ["x"]}, "op": "not", "action": "repeat"}, {"attrs": {}, "action": "restart-from-here"}], "after": {"action": "restart-from-here", "yield": [{"dst": "$m"}]}}]})
    assert play(p, [(0, "x"), (3000, "y")]) == {"$m": 1}
    assert play(p, [(200, "x"), (300, "x"), (400, "x"), (500, "x")]) == {"$m": 1}


def test_non_exhaustive():
    with pytest.raises(NonExhaustive, match="No clause of a"):
        play("a ->\n    receive\n        type = 'x' -> repeat", [(0, "y")])


def test_quit_ends_one_tuple_only():
    text = "foreach %t in @z\n    a ->\n        receive\n            type = %t -> yield $n, quit\n            k = '1' -> yield $k\n            * -> repeat"
    got = play(text, [(0, "x", "1"), (1, "y", "1"), (2, "x", "1")], tuples=[(0, "x"), (1, "y"), (2, "z")])
    # shared: three times $k; x left at 0, y at 1 after one $k
    assert got == {(None, "$k"): 3, (0, "$n"): 1, (0, "$k"): -3, (1, "$n"): 1, (1, "$k"): -2}


def test_sets_never_hold_the_empty_string_but_scalars_match_it():
    text = "foreach %t,#s in @z\n    a ->\n        receive\n            type = %t -> yield $t\n            k in #s -> yield $s\n            * -> repeat"
    got = play(text, [(0, "", ""), (1, "q", "1")], tuples=[(0, "", frozenset(["1"]))])
    assert got == {(0, "$t"): 1, (0, "$s"): 1}


def test_variables_shown_by_calls():
    text = "foreach %t,%tag in @z\n    a ->\n        receive\n            k = '1' -> yield f(%tag) to &s\n            * -> repeat"
    got = play(text, [(0, "x", "1")], tuples=[(0, "x", "A"), (1, "y", "B")], functions={"f": str.lower})
    assert got == {(0, "&s", ("a",)): 1, (1, "&s", ("b",)): 1}


def test_timestamp_against_a_tuple():
    text = "foreach %t in @z\n    a ->\n        receive\n            timestamp >= %t -> yield $n\n            * -> repeat"
    assert play(text, [(5, "x"), (10**10, "x")], tuples=[(0, "5"), (1, "6")]) == {(0, "$n"): 2, (1, "$n"): 1}


def trails(*histories):
    return [{f"h{i}": [{"timestamp": t, "type": a, "k": k} for t, a, k in h] for i, h in enumerate(histories)}]


def test_repeated_neighbours_are_dropped(spark):
    text = "a ->\n    receive\n        type = 'x' -> yield $n\n        * -> repeat"
    h = [(0, "x", "1"), (0, "x", "1"), (0, "x", "2"), (0, "x", "1"), (1, "x", "1")]
    for plan in ("stateless", "matcher"):
        assert as_json(run(text, histories_from_json(spark, trails(h)), plan=plan)) == {"$n": 4}


def test_state_goes_on_over_sources(spark):
    parts = [{"a": [{"timestamp": 0, "type": "c"}]}, {"a": [{"timestamp": 5, "type": "c"}], "b": []}, {"a": [{"timestamp": 11, "type": "c"}, {"timestamp": 12, "other": "q"}]}]
    assert as_json(run(SKIP, histories_from_json(spark, parts))) == {"$n": 2}


def test_overlap_is_dropped(spark):
    parts = [{"a": [{"timestamp": 0, "type": "c"}, {"timestamp": 50, "type": "c"}]}, {"a": [{"timestamp": 20, "type": "c"}, {"timestamp": 60, "type": "c"}]}]
    text = "a ->\n    receive\n        type = 'c' -> yield $n\n        * -> repeat"
    for plan in ("stateless", "matcher"):
        assert as_json(run(text, histories_from_json(spark, parts), plan=plan)) == {"$n": 3}
        assert as_json(run(text, histories_from_json(spark, parts), drop_overlap=False, plan=plan)) == {"$n": 4}


def test_missing_values_are_reported(spark):
    source = histories_from_json(spark, trails([(0, "x", "1")]))
    with pytest.raises(ValueError, match="missing parameters: %p"):
        run("a ->\n    receive\n        type = %p -> yield $n\n        * -> repeat", source)
    with pytest.raises(ValueError, match="calls f"):
        run("a ->\n    receive\n        * -> yield f(k) to #s", source)
    with pytest.raises(ValueError, match="can't be called with 1"):
        run("a ->\n    receive\n        * -> yield f(k) to #s", source, functions={"f": lambda a, b: a})
    with pytest.raises(ValueError, match="binds 1"):
        run("foreach %t in @z\n    a ->\n        receive\n            type = %t -> yield $n\n            * -> repeat", source, {"@z": [["a", "b"]]})
    with pytest.raises(ValueError, match="has to be a string"):
        run("foreach %t in @z\n    a ->\n        receive\n            type = %t -> yield $n\n            * -> repeat", source, {"@z": [[["a"]]]})
    with pytest.raises(Exception, match="No clause of a matches"):
        as_json(run("a ->\n    receive\n        type = 'y' -> yield $n", source))


def test_hooks_run_around(spark):
    seen = []
    calls = Functions({"f": lambda a: a + "!"}, lambda: seen.append("in"), lambda: seen.append("out"))
    program, source = "a ->\n    receive\n        * -> yield f(k) to &s", histories_from_json(spark, trails([(0, "x", "1")]))
    with run(program, source, functions=calls) as result:
        assert seen == ["in"]
        assert as_json(result) == {"&s": {"1!": 1}} and seen == ["in"]
    assert seen == ["in", "out"]
    result.close()
    assert seen == ["in", "out"]
    with calls.around():  # open for several runs
        for _ in range(2):
            assert as_json(run(program, source, functions=calls)) == {"&s": {"1!": 1}}
        assert seen == ["in", "out", "in"]
    assert seen == ["in", "out", "in", "out"]
    with pytest.raises(ValueError):
        run(program + ", yield g(k) to &s", source, functions=calls)
    assert seen == ["in", "out"] * 2


def test_sketch_registers(spark):
    got = run("a ->\n    receive\n        * -> yield k to ^s", histories_from_json(spark, trails([(0, "x", "u"), (1, "x", "v")])))
    want = {slot("u"), slot("v")}
    assert {(int(r["key"][0]), r["n"]) for r in got.long().collect()} == want


def test_encoded_sketch(spark):
    assert encode_tuple(["6162", "a,b\0", ""], [True, False, False]) == b"Bab,Sa\xff\xfdb\xff\xfe,S"
    source = histories_from_json(spark, trails([(0, "x", "u")]))
    got = run("a ->\n    receive\n        * -> yield cookie,k to ^s", source, hll_input="encoded").long().first()
    assert (int(got["key"][0]), got["n"]) == slot(b"Bh0" + b"\xff\xfe" * 14 + b",Su")
    with pytest.raises(ValueError, match="No such input"):
        run("a ->\n    receive\n        * -> yield $n", source, hll_input="other")


def test_empty_source(spark):
    empty = histories_from_json(spark, [{}])
    text = "foreach %t in @z\n    a ->\n        receive\n            type = %t -> yield $n, yield k to #s, yield k to &m, yield k to ^h\n            * -> repeat"
    for plan in ("stateless", "matcher"):
        assert as_json(run(text, empty, {"@z": [["a"]]}, plan=plan)) == [{"$n": 0, "#s": [], "&m": {}, "^h": "0e00", "%t": "a"}]
        assert as_json(run(text, empty, {"@z": []}, plan=plan)) == []


FLAT = [
    "a ->\n    receive\n        type = 'a', k = '1' -> yield $p, yield k,type to &m\n        type = 'a' -> yield k to #s\n        timestamp >= 5 -> yield $late, yield timestamp to ^h\n        * -> repeat",
    "foreach %t in @t\n    a ->\n        receive\n            type = %t -> yield $n, yield k to #s\n            k = '1' -> yield $one, yield type to &m\n            * -> repeat",
    "foreach %t,#k in @tk\n    a ->\n        receive\n            k = '2' -> yield $two\n            type = %t, k in #k -> yield $n, yield cookie to #who\n            * -> yield $rest",
    "foreach %t,#k in @tk merged results\n    a ->\n        receive\n            type = %t, k in #k, timestamp < 7 -> yield $n, yield k to &m, yield k to ^h\n            type = 'b' -> yield $b\n            * -> repeat",
    "a ->\n    receive\n        type = 'b', k = '1' -> yield $b, quit\n        k = '3' -> quit\n        type = 'a' -> yield $a, yield k to #s, repeat\n        * -> yield $rest",
    "foreach %t\n    a ->\n        receive\n            type = %t -> yield $n\n            * -> repeat",
]
PARAMS = {"@t": [["a"], ["b"], ["nosuch"], [""]], "@tk": [["a", ["1", "2"]], ["b", ["2", ""]], ["a", []], ["a", ["1"]]]}
event = st.tuples(st.integers(0, 9), st.sampled_from(["a", "b", ""]), st.sampled_from(["1", "2", "3", ""]))


@pytest.mark.parametrize("text", FLAT)
def test_both_plans_agree(spark, text):
    rng = random.Random(7)
    histories = [sorted(((rng.randrange(10), rng.choice(["a", "b", ""]), rng.choice(["1", "2", "3", ""])) for _ in range(rng.randrange(12))), key=lambda e: e[0]) for _ in range(20)]
    histories.append([(0, "b", ""), (0, "b", ""), (1, "a", "1")])
    sources = histories_from_json(spark, trails(*histories))
    key = lambda x: sorted(map(str, x)) if isinstance(x, list) else str(x)
    a, b = (as_json(run(text, sources, PARAMS, plan=plan)) for plan in ("stateless", "matcher"))
    assert key(a) == key(b)


STEPS = "a ->\n    receive\n        type = 'a' -> w\n        * -> repeat\nw ->\n    window\n        b ->\n            receive\n                type = 'b' -> yield $b, c\n                * -> repeat\n            after 3s -> yield $tb, c\n        c ->\n            receive\n                type = 'a', k = '1' -> yield $c, a\n                * -> repeat\n            after 2s -> yield $tc, b\n    after 7s -> yield $w, a"


@settings(max_examples=200, deadline=None)
@given(st.lists(event, max_size=25).map(lambda h: sorted((t * 2, a, k) for t, a, k in h)), st.integers(0, 25), st.booleans())
def test_saved_state_changes_nothing(events, at, eager):
    p = parse(STEPS)
    make = lambda: Matcher(Machine(p, p.fields, {}, eager), [], None, True, len(p.fields))
    whole, first = make(), make()
    for e in events:
        whole.feed("h", 0, e[0], 0, 0, tuple(e[1:]))
    for e in events[:at]:
        first.feed("h", 0, e[0], 0, 0, tuple(e[1:]))
    second = make()
    second.resume(first.save())
    for e in events[at:]:
        second.feed("h", 0, e[0], 0, 0, tuple(e[1:]))
    whole.close()
    second.close()
    total = {}
    for t, var, value, n in [*first.drain(), *second.drain()]:
        total[t, var, value] = total.get((t, var, value), 0) + n
    assert total == {(t, var, value): n for t, var, value, n in whole.drain()}


@settings(max_examples=200, deadline=None)
@given(st.lists(event, max_size=20).map(sorted))
def test_shared_machines_give_what_separate_ones_do(events):
    text = "foreach %t,#k in @z\n    a ->\n        receive\n            type = %t -> yield $t, b\n            k = '3' -> yield $three, b\n            * -> repeat\n    b ->\n        receive\n            k in #k -> yield $k, yield k to #s, a\n            type = 'b' -> quit\n            * -> yield $rest, repeat\n        after 4s -> yield $late, a"
    p = parse(text)
    rows = [(0, "a", frozenset(["1"])), (1, "b", frozenset(["2", "3"])), (2, "zz", frozenset())]
    shared = play(p, events, tuples=rows)
    total = {}
    for k, n in shared.items():
        for t in (0, 1, 2) if k[0] is None else (k[0],):
            total[(t, *k[1:])] = total.get((t, *k[1:]), 0) + n
    alone = {}
    for row in rows:
        for k, n in play(p, events, tuples=[row]).items():
            key = (row[0], *k[1:])
            alone[key] = alone.get(key, 0) + n
    assert {k: n for k, n in total.items() if n} == {k: n for k, n in alone.items() if n}
