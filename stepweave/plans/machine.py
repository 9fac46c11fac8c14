"""The matcher: one state machine for each history, and for each foreach tuple that a history is about.

A state is [block, expiry, outer windows]; an outer window is [block, expiry].
Events come in order; what is pending at the end of a history is settled by one
empty event beyond all times.

Tuples share one machine as long as none of their values has occurred in the
history: it runs with values that nothing equals. When an event first has a
value of a tuple, the tuple's own machine is split off with the shared state.
Results of the shared machine count for all tuples (tuple None) and are taken
back from those split off before, so the work follows the values that occur and
not the number of tuples.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from ..dsl.program import After, Call, Clause, Field, Literal, Move, Param, Program, WindowStart, Yield
from ..functions.hll import PRECISION, encode_tuple, slot

NEVER = (1 << 64) - 1
END_TS = (1 << 64) - 2
_COMPARE = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class NonExhaustive(ValueError):
    """An event that no clause of its block matches."""


class _Nothing:
    """Equals no value and holds none; foreach variables of tuples that aren't in a history."""

    def __eq__(self, other: object) -> bool:
        return False

    __hash__ = None

    def __contains__(self, x: object) -> bool:
        return False


NOTHING = _Nothing()


@dataclass
class History:
    """What yields may use besides the event."""

    key: str
    start: int
    end: int


class Machine:
    """A program compiled to closures over event values, by position in ``fields``."""

    def __init__(self, program: Program, fields: list[str], functions: dict[str, Callable[..., str]], eager_outer_expiry: bool = False, encoded_sketches: bool = False, precision: int = PRECISION):
        self.program, self.functions, self.eager, self.encoded, self.precision = program, functions, eager_outer_expiry, encoded_sketches, precision
        self.place = {f: i for i, f in enumerate(fields)}
        self.variables = {v: i for i, v in enumerate((*program.bound, *program.free))}
        self.depth = [len(b.windows) for b in program.blocks]
        self.duration = [b.duration for b in program.blocks]
        self.clauses = [[(self._test(c), self._edge(b.index, c)) for c in b.clauses] for b in program.blocks]
        self.after = [self._edge(b.index, b.after) for b in program.blocks]
        self.names = [b.name for b in program.blocks]
        self.is_window = [b.is_window for b in program.blocks]

    def _test(self, clause: Clause) -> Callable[[tuple, int, list], bool]:
        tests = [self._condition(c) for c in clause.conditions]
        if not tests:
            return (lambda e, ts, p: False) if clause.negated else (lambda e, ts, p: True)
        if clause.negated:
            return lambda e, ts, p: not all(t(e, ts, p) for t in tests)
        if len(tests) == 1:
            return tests[0]
        return lambda e, ts, p: all(t(e, ts, p) for t in tests)

    def _condition(self, c) -> Callable[[tuple, int, list], bool]:
        param = self.variables[c.operand.name] if isinstance(c.operand, Param) else None
        if c.field == "timestamp":
            compare, value = _COMPARE[c.op], c.operand
            if param is None:
                return lambda e, ts, p: compare(ts, value)
            return lambda e, ts, p: compare(ts, int(p[param]))
        at, value = self.place[c.field], c.operand
        if param is None:
            return lambda e, ts, p: e[at] == value
        if c.op == "in":
            return lambda e, ts, p: e[at] in p[param]
        return lambda e, ts, p: p[param] == e[at]

    def _edge(self, index: int, edge: Clause | After) -> tuple[list, Move]:
        return [(y.target, self._sketched(y) if y.kind == "hll" else None, [self._term(index, t) for t in y.terms]) for y in edge.yields], edge.move

    def _sketched(self, y: Yield) -> Callable[[tuple], tuple[str, str]]:
        """Values to register and rank."""
        raw = [isinstance(t, Field) and t.name == "cookie" for t in y.terms]
        text = (lambda values: encode_tuple(values, raw)) if self.encoded else ",".join
        return lambda values: tuple(map(str, slot(text(values), self.precision)))

    def _term(self, index: int, t) -> Callable[[tuple | None, int, list, list, History], str]:
        if isinstance(t, Field):
            if t.name == "cookie":
                return lambda e, ts, p, s, h: h.key
            if t.name == "timestamp":
                return lambda e, ts, p, s, h: str(ts)
            if t.name == "cookie_timestamp_filter_start":
                return lambda e, ts, p, s, h: "0" if e is None else str(h.start)
            if t.name == "cookie_timestamp_filter_end":
                return lambda e, ts, p, s, h: "0" if e is None else str(h.end)
            at = self.place[t.name]
            return lambda e, ts, p, s, h: "" if e is None else e[at]
        if isinstance(t, Literal):
            text = str(t.value)
            return lambda e, ts, p, s, h: text
        if isinstance(t, Param):
            param = self.variables[t.name]
            return lambda e, ts, p, s, h: p[param]
        if isinstance(t, WindowStart):
            if t.block is None:
                d = self.program.blocks[index].duration
                return lambda e, ts, p, s, h: str(s[1] - d)
            d, ref = self.program.blocks[t.block].duration, t.block
            return lambda e, ts, p, s, h: str(next(x for b, x in s[3] if b == ref) - d)
        assert isinstance(t, Call)
        f, args = self.functions[t.name], [self._term(index, a) for a in t.args]
        return lambda e, ts, p, s, h: f(*[a(e, ts, p, s, h) for a in args])

    def start(self) -> list:
        """[block, expiry, outer windows, outer windows as a yield sees them]"""
        return [self.program.entry, NEVER, [], []]

    def is_initial(self, s: list) -> bool:
        return s[0] == self.program.entry and s[1] == NEVER and not s[2]

    def _enter(self, s: list, index: int, ts: int) -> None:
        while True:
            d = self.duration[index]
            expiry = NEVER if d is None else (min(ts, s[1]) if s[1] > 0 else ts) + d
            if not self.is_window[index]:
                s[0], s[1] = index, expiry
                return
            s[2] = [*s[2], (index, expiry)]
            index += 1

    def _take(self, s: list, edge: tuple[list, Move], e: tuple | None, ts: int, p: list, h: History, emit: Callable) -> bool:
        """Yields and moves; whether the event has been taken."""
        yields, move = edge
        for target, sketched, terms in yields:
            values = tuple([t(e, ts, p, s, h) for t in terms])
            emit(target, sketched(values) if sketched else values)
        if move.kind == "repeat":
            return True
        if move.kind == "quit":
            s[0], s[2] = -1, []
            return True
        s[2] = s[2][: self.depth[move.block]]
        self._enter(s, move.block, ts)
        return move.kind == "next"

    def step(self, s: list, e: tuple | None, ts: int, p: list, h: History, emit: Callable) -> None:
        """One event; None is the end of the history."""
        if s[0] >= 0 and self.is_window[s[0]]:  # an entry block that is a window starts at the first event
            if e is None:
                return
            self._enter(s, s[0], ts)
        taken = False
        while s[0] >= 0 and not taken:
            block = s[0]
            lapsed = next((i for i, (_, x) in enumerate(s[2]) if x <= ts), None)
            if e is not None and s[1] > ts and not (self.eager and lapsed is not None):
                for test, edge in self.clauses[block]:
                    if test(e, ts, p):
                        s[3] = s[2]
                        taken = self._take(s, edge, e, ts, p, h, emit)
                        break
                else:
                    raise NonExhaustive(f"No clause of {self.names[block]} matches an event at {ts} of {h.key}")
                continue
            taken = e is None
            s[3] = s[2]
            if lapsed is not None:
                outer = s[2][lapsed][0]
                s[2] = s[2][:lapsed]
                taken = self._take(s, self.after[outer], e, ts, p, h, emit) or taken
            else:
                taken = self._take(s, self.after[block], e, ts, p, h, emit) or taken


class Tuples:
    """foreach tuples by the values that their variables may equal."""

    def __init__(self, program: Program, rows: list[tuple]):
        self.values = {r[0]: list(r[1:]) for r in rows}
        self.by_field: list[tuple[str, dict[str, list[int]]]] = []
        uses_time = any(c.field == "timestamp" and isinstance(c.operand, Param) and c.operand.name in program.bound for c in program.conditions)
        #: Yields that show a variable, and comparisons that nothing can stand for, differ between tuples from the start.
        self.all_differ = uses_time or any(isinstance(t, Param) and t.name in program.bound for t in program.terms)
        for k, v in enumerate(program.bound):
            index: dict[str, list[int]] = {}
            for r in rows:
                for x in r[k + 1] if isinstance(r[k + 1], frozenset) else [r[k + 1]]:
                    if x or v[0] == "%":
                        index.setdefault(x, []).append(r[0])
            for f in program.variable_fields(v):
                if f != "timestamp":
                    self.by_field.append((f, index))


class Matcher:
    """Runs over events that come in order of key and time, and adds up (tuple, variable, value): count."""

    def __init__(self, machine: Machine, free: list, tuples: Tuples | None, remove_repeats: bool, n_fields: int):
        self.machine, self.free, self.tuples, self.remove_repeats, self.n_fields = machine, free, tuples, remove_repeats, n_fields
        self.counts: dict[tuple, int] = {}
        self.history: History | None = None
        self.index = [(machine.place[f], index) for f, index in tuples.by_field] if tuples else []

    def _count(self, t: int | None, n: int = 1) -> Callable:
        counts = self.counts

        def emit(target: str, value: tuple) -> None:
            k = t, target, value
            counts[k] = counts.get(k, 0) + n

        return emit

    def _shared(self, target: str, value: tuple) -> None:
        self._count(None)(target, value)
        for t in self.own:
            self._count(t, -1)(target, value)

    def _begin(self, key: str, start: int, end: int) -> None:
        self.history = History(key, start, end)
        self.last = None
        self.own: dict[int, tuple[list, list, Callable]] = {}
        n = len(self.machine.program.bound)
        self.shared = self.machine.start()
        self.nothing = [NOTHING] * n + self.free
        if self.tuples and self.tuples.all_differ:
            for t in self.tuples.values:
                self._split(t)
            self.shared[0] = -1

    def _split(self, t: int) -> None:
        s = self.shared
        self.own[t] = [*s[:2], list(s[2]), list(s[3])], self.tuples.values[t] + self.free, self._count(t)

    def _step(self, e: tuple | None, ts: int) -> None:
        m, h = self.machine, self.history
        if self.tuples is None:
            m.step(self.shared, e, ts, self.free, h, self._count(None))
            return
        if e is not None and not self.tuples.all_differ:
            for at, index in self.index:
                for t in index.get(e[at], ()):
                    if t not in self.own:
                        self._split(t)
        m.step(self.shared, e, ts, self.nothing, h, self._shared)
        for s, p, emit in self.own.values():
            m.step(s, e, ts, p, h, emit)

    def _finish(self) -> None:
        """The end of the history, for machines that are under way."""
        m, h = self.machine, self.history
        if h is None:
            return
        if not m.is_initial(self.shared):
            m.step(self.shared, None, END_TS, self.free if self.tuples is None else self.nothing, h, self._count(None) if self.tuples is None else self._shared)
        for s, p, emit in self.own.values():
            if not m.is_initial(s):
                m.step(s, None, END_TS, p, h, emit)
        self.history = None

    def feed(self, key: str, source: int, ts: int, start: int, end: int, event: tuple) -> None:
        if self.history is None or key != self.history.key:
            self._finish()
            self._begin(key, start, end)
        self.history.start, self.history.end = start, end
        if self.remove_repeats:
            if self.last == (source, ts, event):
                return
            self.last = source, ts, event
        self._step(event[: self.n_fields], ts)

    def drain(self) -> Iterator[tuple]:
        for (t, target, value), n in self.counts.items():
            if n:
                yield t, target, value, n
        self.counts.clear()

    def close(self) -> None:
        self._finish()

    def save(self) -> tuple | None:
        """The open history as plain values, for ``resume``."""
        h = self.history
        return None if h is None else ((h.key, h.start, h.end), self.last, self.shared, {t: s for t, (s, _, _) in self.own.items()})

    def resume(self, saved: tuple | None) -> None:
        if saved is None:
            return
        (key, start, end), last, shared, own = saved
        self._begin(key, start, end)
        self.last, self.shared = last, shared
        self.own = {t: (s, self.tuples.values[t] + self.free, self._count(t)) for t, s in own.items()}
