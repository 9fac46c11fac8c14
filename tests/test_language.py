import pytest

from stepweave import ParseError, from_ir, parse, plan_of, to_ir
from stepweave.dsl.program import Call, Condition, Field, Literal, Move, Param, WindowStart
from stepweave.queries import NEGATED, QUERIES
from stepweave.sinks.diagram import to_dot

NESTED = """
-- a comment
foreach %a,#b in @arr merged results
    start ->
        receive
            type = "x", a = %a, b in #b, timestamp >= '2014-01-01', \\
              timestamp < 7 -> outer
            * -> repeat
    outer ->
        window
            inner ->
                receive
                    type = '' -> yield $n, yield start_timestamp[outer],f(a, "q", 3, %a, g(b)) to #s, other
                    * -> repeat
                after 10m -> other
            other ->
                receive
                    * -> quit
        after 2h -> yield $late, start
"""


def test_parse_nested():
    p = parse(NESTED)
    assert [(b.name, b.index, b.windows, b.duration, b.is_window) for b in p.blocks] == [("start", 0, (), None, False), ("outer", 1, (), 7200, True), ("inner", 2, (1,), 600, False), ("other", 3, (1,), None, False)]
    assert p.foreach.variables == ("%a", "#b") and p.foreach.array == "@arr" and p.foreach.merged
    first = p.blocks[0].clauses[0]
    assert first.conditions == (Condition("type", "=", "x"), Condition("a", "=", Param("%a")), Condition("b", "in", Param("#b")), Condition("timestamp", ">=", 1388534400), Condition("timestamp", "<", 7))
    assert first.move == Move("next", 1)
    assert p.blocks[2].clauses[0].yields[1].terms == (WindowStart(1), Call("f", (Field("a"), Literal("q"), Literal(3), Param("%a"), Call("g", (Field("b"),)))))
    assert p.blocks[1].after.move == Move("here", 0) and p.blocks[3].clauses[0].move == Move("quit")
    assert p.blocks[3].after.move == Move("here", 0)
    assert p.results == {"$n": "counter", "#s": "set", "$late": "counter"}
    assert p.fields == ["type", "a", "b"] and p.free == [] and p.functions == ["f", "g"]


def test_json_form_round_trip():
    p = parse(NESTED)
    q = from_ir(to_ir(p))
    assert to_ir(q) == to_ir(p)
    assert q.blocks == p.blocks and q.foreach == p.foreach
    assert from_ir(NEGATED).entry == 1


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("", "needs a block"),
        ("a ->\n    receive\n        * -> nowhere", "Label not found: nowhere"),
        ("a ->\n    receive\n        * -> repeat\nb ->\n    receive\n        * -> yield $n", "adding repeat"),
        ("a ->\n    receive\n        * -> repeat\n    after 3s -> repeat", "can't repeat"),
        ("a ->\n    receive\n        x < 3 -> repeat", "timestamps only"),
        ("a ->\n    receive\n        x = '2014-01-01' -> repeat", "expected"),
        ("a ->\n    receive\n        x\t= 'b' -> repeat", "Unexpected"),
        ("a ->\n    receive\n        x = 'b' -> repeat\n      y = 'b' -> repeat", "indented like none"),
        ("a ->\n    window\n        b ->\n            receive\n                * -> repeat\n    after -> a", "duration"),
        ("a ->\n    receive\n        * -> c\nw ->\n    window\n        c ->\n            receive\n                * -> repeat\n    after 3s -> a", "into a window from outside"),
        ("a ->\n    receive\n        * -> yield start_timestamp to #s", "a duration"),
        ("a ->\n    receive\n        * -> yield x to $s", "expected"),
        ("foreach %x\n    a ->\n        receive\n            * -> repeat", "compared with one field"),
        ("a ->\n    receive\n        x in %s -> repeat", "set parameter"),
        ("a ->\n    receive\n        receive = 'x' -> repeat", "a name"),
        ("a ->\n    receive\n        * -> b\nb ->\n    receive\n        * -> repeat\n    after 0s -> b", "circles"),
        ("a ->\n    receive\n        timestamp > '2014-13-01' -> repeat", "No such date"),
    ],
)
def test_errors(text, said):
    with pytest.raises(ParseError, match=said):
        parse(text)


def test_error_place():
    with pytest.raises(ParseError) as e:
        parse("a ->\n    receive\n        * -> ?")
    assert (e.value.line, e.value.position) == (3, 14)


def test_not_supported():
    with pytest.raises(ParseError, match="Not supported"):
        from_ir({"rules": [{"clauses": [{"attrs": {}, "action": "restart-from-start"}]}]})


def test_plan_choice():
    assert plan_of(parse("a ->\n    receive\n        * -> yield $n")) == "stateless"
    assert plan_of(parse("a ->\n    receive\n        * -> quit")) == "stateless"
    assert plan_of(parse("a ->\n    receive\n        x = 'y' -> quit")) == "matcher"
    assert plan_of(parse("a ->\n    receive\n        * -> repeat\nb ->\n    receive\n        * -> quit")) == "matcher"
    assert plan_of(parse("foreach %x,%y in @z\n    a ->\n        receive\n            p = %x -> yield $n\n            q = %y -> yield $m\n            * -> repeat")) == "matcher"


def test_diagram():
    text = to_dot(parse("a ->\n    receive\n        type = 'x' -> yield $n, b\n        * -> repeat\nb ->\n    receive\n        * -> quit\n    after 3s -> a"))
    assert '"a" -> "b" [label="type = \'x\'\\nyield $n"];' in text and '"b" -> "a" [label="after 3s"];' in text
    with pytest.raises(ValueError):
        to_dot(parse(NESTED))


def test_queries_have_names():
    assert len(QUERIES) > 40
