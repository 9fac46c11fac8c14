"""Cases generated from patterns of events, without chance: the same text gives the same cases.

    # A title
    Window: 30 days
    Input: @arr = %a, %b
    Params: #set = x y, %from = 0
    Output: $n = 1
    -Params: %from = 9999999
    -Output: $n = 0
    Positive Only
    [ type=imp, a=%a ]
    < min 1 second, max 3 days >
    [ !type=pxl, b=%b, c in #set ]

Every way to satisfy the pattern makes a history with tuple values of its own,
which has to give the output. Unless "Positive Only" stands there, every way
to break some of the events makes one that has to give zeros. Before each event
come fillers that miss it by one field; fields with ! are changed in every
filler and broken event. Lines with - give other parameters and outputs for
the same histories.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
_TIME = re.compile(r"(\d+)\s*(second|minute|hour|day)s?")


def _seconds(text: str) -> int:
    m = _TIME.fullmatch(text.strip())
    if not m:
        raise ValueError(f"no length of time: {text}")
    return int(m[1]) * _UNITS[m[2]]


@dataclass
class Rule:
    name: str
    value: str  # a text, %variable or #set
    must_change: bool


@dataclass
class Gap:
    least: int
    most: int | None


@dataclass
class Scenario:
    title: str
    window: int | None = None
    array: str = "@arr"
    variables: list[str] = field(default_factory=list)
    settings: list[tuple[dict, dict]] = field(default_factory=lambda: [({}, {})])  # (params, outputs), the first one and others
    positive_only: bool = False
    steps: list[list[Rule] | Gap] = field(default_factory=list)

    @property
    def events(self) -> list[list[Rule]]:
        return [s for s in self.steps if isinstance(s, list)]

    def _sets(self) -> dict[str, list[str]]:
        names = {r.value for e in self.events for r in e if r.value[0] == "#"}
        return {n: self.settings[0][0].get(n) or [f"{n[1:]}-{k}" for k in (1, 2)] for n in names}

    def _broken(self, rules: list[Rule], event: dict[str, str]) -> list[dict[str, str]]:
        """Events that miss the rules by one field, and by those that must change."""
        out = []
        must = [r for r in rules if r.must_change]
        for r in rules:
            changed = dict(event)
            for x in (r, *(must if must and not r.must_change else ())):
                literals = sorted({y.value for e in self.events for y in e if y.name == x.name and y.value[0] not in "%#"} - {x.value})
                for_text = x.value[0] not in "%#"
                changed[x.name] = literals[0] if for_text and literals else f"not-{event[x.name]}"
            out.append(changed)
        return out

    def _times(self) -> list[list[int]]:
        """Offsets from event to event: the least and the most of each gap, inside the window."""
        gaps: list[list[int]] = []
        last: Gap | None = None
        for s in self.steps:
            if isinstance(s, Gap):
                last = s
                continue
            if not gaps:
                gaps.append([0])
            elif last is None:
                gaps.append([1])
            else:
                most = last.most - 1 if last.most is not None else last.least + 86400
                gaps.append(sorted({last.least, max(last.least, most)}))
            last = None
        found = [list(x) for x in product(*gaps)]
        return [x for x in found if self.window is None or sum(x) < self.window] or found[:1]

    def _histories(self) -> list[tuple[list[int], list[dict[str, str]], set[int]]]:
        """(offsets, set values by event, broken events)"""
        sets = self._sets()
        per_event = [[dict(zip([r.name for r in e if r.value[0] == "#"], x)) for x in product(*[sets[r.value] for r in e if r.value[0] == "#"])] for e in self.events]
        n = len(self.events)
        out = [(t, list(c), set()) for t in self._times() for c in product(*per_event)]
        if not self.positive_only:
            first = [c[0] for c in per_event]
            out += [(self._times()[0], first, {i for i in range(n) if mask >> i & 1}) for mask in range(1, 1 << n)]
        return out

    def cases(self) -> dict:
        """In the form that check_cases takes; all histories lie in one source."""
        trails: dict[str, list[dict]] = {}
        tuples, good = [], []
        for k, (offsets, chosen, broken) in enumerate(self._histories()):
            values = {v: f"{v[1:]}{k}" for v in self.variables}
            tuples.append([values[v] for v in self.variables])
            good.append(not broken)
            now, events = 0, []
            for i, rules in enumerate(self.events):
                event = {r.name: values.get(r.value, chosen[i].get(r.name, r.value)) for r in rules}
                misses = self._broken(rules, event)
                events += [{"timestamp": now} | m for m in misses]
                now += offsets[i]
                events.append({"timestamp": now} | (misses[0] if i in broken else event))
            trails[f"history{k}"] = events
        tests = []
        for j, (params, outputs) in enumerate(self.settings):
            own = self._sets() | {k: v for k, v in self.settings[0][0].items()} | params
            zero = dict.fromkeys(outputs, 0)
            if self.variables:
                expected: list | dict = [dict(zip(self.variables, t)) | (outputs if g else zero) for t, g in zip(tuples, good)]
                own |= {self.array: tuples}
            else:
                expected = {name: n * sum(good) for name, n in outputs.items()}
            tests.append({"desc": self.title + (f" ({j})" if j else ""), "trails": [trails], "expected": expected, "params": own})
        return {"tests": tests}


def _settings(text: str) -> dict:
    out: dict = {}
    for part in text.split(","):
        name, _, value = (x.strip() for x in part.partition("="))
        if name[0] == "#":
            out |= {name: value.split()} if value else {}
        else:
            out[name] = value
    return out


def parse_scenarios(text: str) -> list[Scenario]:
    found: list[Scenario] = []
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if not line:
            continue
        if line[0] == "#":
            found.append(Scenario(line[1:].strip()))
            continue
        if not found:
            raise ValueError(f"line {number}: a title comes first")
        s = found[-1]
        other, line = line[0] == "-", line.lstrip("-").strip()
        key, _, rest = (x.strip() for x in line.partition(":"))
        if line[0] == "[" and line[-1] == "]":
            rules = []
            for part in line[1:-1].split(","):
                m = re.fullmatch(r"\s*(!?)\s*(\w+)\s*(?:=|in(?=\s+#))\s*(\S+)\s*", part)
                if not m:
                    raise ValueError(f"line {number}: no field: {part}")
                rules.append(Rule(m[2], m[3], bool(m[1])))
            s.steps.append(rules)
        elif line[0] == "<" and line[-1] == ">":
            parts = dict(x.strip().split(None, 1) for x in line[1:-1].split(","))
            if set(parts) - {"min", "max"}:
                raise ValueError(f"line {number}: min and max only")
            s.steps.append(Gap(_seconds(parts["min"]) if "min" in parts else 0, _seconds(parts["max"]) if "max" in parts else None))
        elif key == "Window":
            s.window = _seconds(rest)
        elif key == "Input":
            s.array, _, names = (x.strip() for x in rest.partition("="))
            s.variables = [x.strip() for x in names.split(",")]
        elif key == "Params":
            if other:
                s.settings.append((_settings(rest), dict(s.settings[0][1])))
            else:
                s.settings[0][0].update(_settings(rest))
        elif key == "Output":
            outputs = {k: int(v) for k, v in _settings(rest).items()}
            if other:
                if len(s.settings) == 1:
                    s.settings.append(({}, {}))
                s.settings[-1] = (s.settings[-1][0], outputs)
            else:
                s.settings[0][1].update(outputs)
        elif line.lower() == "positive only":
            s.positive_only = True
        else:
            raise ValueError(f"line {number}: {line}")
    return found
