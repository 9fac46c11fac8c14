import json

import pytest

from stepweave.__main__ import main
from stepweave.testing import check_cases, embedded_cases, parse_scenarios

PROGRAM = """
foreach %camp,%group in @arr
    start ->
        receive
            type = "imp", campaign = %camp, adgroup = %group -> seen
            * -> repeat
    seen ->
        receive
            type = "pxl", campaign = %camp, segment in #segments, timestamp >= %from -> yield $engaged, quit
            * -> repeat
        after 3d -> start
"""

SCENARIOS = """
# Engaged
Window: 30 days
Input: @arr = %camp, %group
Params: #segments = s1 s2, %from = 0
Output: $engaged = 1
-Params: %from = 99999999
-Output: $engaged = 0
[ type=imp, campaign=%camp, adgroup=%group ]
< min 1 second, max 3 days >
[ !type=pxl, campaign=%camp, segment in #segments ]

# Only the good ones
Input: @arr = %camp, %group
Params: #segments, %from = 0
Output: $engaged = 1
Positive Only
[ type=imp, campaign=%camp, adgroup=%group ]
[ type=pxl, campaign=%camp, segment in #segments ]
"""

CASES = """
-- unit tests --
-- {"tests": [{"desc": "one", "trails": [{"a": [{"type": "imp", "timestamp": 1, "campaign": "c", "adgroup": "g"},
--    {"type": "pxl", "timestamp": 2, "campaign": "c", "segment": "s"}]}], "expected": [{"%camp": "c", "%group": "g", "$engaged": WANT}]}],
--  "params": {"@arr": [["c", "g"]], "#segments": ["s"], "%from": "0"}}
"""


def test_scenarios(spark):
    engaged, good = parse_scenarios(SCENARIOS)
    cases = engaged.cases()
    assert cases == engaged.cases() and len(cases["tests"]) == 2
    # two times and two segments that satisfy the pattern, three ways to break it
    assert len(cases["tests"][0]["expected"]) == 2 * 2 + 3
    assert sum(x["$engaged"] for x in cases["tests"][0]["expected"]) == 4
    assert check_cases(spark, PROGRAM, cases) == []
    assert check_cases(spark, PROGRAM, good.cases()) == []
    # a program that forgets the type is found out
    assert check_cases(spark, PROGRAM.replace('type = "pxl", ', ""), {"tests": cases["tests"][:1]})


@pytest.mark.parametrize("text", ["[ a=1 ]", "# t\n< fast >", "# t\n[ a ]", "# t\nWindow: 3 weeks", "# t\nnonsense"])
def test_scenario_errors(text):
    with pytest.raises(ValueError):
        parse_scenarios(text)


def test_embedded_cases(spark):
    assert check_cases(spark, PROGRAM + CASES.replace("WANT", "1")) == []
    assert check_cases(spark, PROGRAM + CASES.replace("WANT", "2")) != []
    assert embedded_cases(PROGRAM) == {"tests": []}


def test_command_line(spark, tmp_path, capsysbinary):
    (tmp_path / "p.tr").write_text(PROGRAM + CASES.replace("WANT", "1"))
    (tmp_path / "params.json").write_text(json.dumps({"@arr": [["c", "g"], ["d", "g"]], "#segments": ["s"], "%from": "0"}))
    (tmp_path / "filter.json").write_text('{"clauses": [[{"field": "type", "value": "zzz", "op": "notequal"}]]}')
    rows = [("u", 1, "imp", "c", "g", ""), ("u", 2, "pxl", "c", "", "s"), ("v", 1, "imp", "d", "g", "")]
    spark.createDataFrame(rows, "user string, time long, type string, campaign string, adgroup string, segment string").write.parquet(str(tmp_path / "events"))
    program, args = str(tmp_path / "p.tr"), ["--id", "user", "--ts", "time", "--params", str(tmp_path / "params.json"), "--filter", str(tmp_path / "filter.json")]
    assert main([program, str(tmp_path / "events"), *args]) == 0
    got = json.loads(capsysbinary.readouterr().out)
    assert got == [{"$engaged": 1, "%camp": "c", "%group": "g"}, {"$engaged": 0, "%camp": "d", "%group": "g"}]
    assert main([program, "--show", "plan"]) == 0 and capsysbinary.readouterr().out.strip() == b"matcher"
    assert main([program, "--show", "json"]) == 0
    (tmp_path / "q.json").write_bytes(capsysbinary.readouterr().out)
    assert main([str(tmp_path / "q.json"), str(tmp_path / "events"), *args]) == 0 and json.loads(capsysbinary.readouterr().out) == got
    assert main([program, "--test"]) == 0
