"""The parsed form of a program, and its validation.

Blocks are numbered in the order of the text, a window before its nested
blocks. Every transition holds a block number; what the text leaves out has
been filled in.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

#: Names that a yield may use besides event fields.
SPECIAL = ("cookie", "timestamp", "cookie_timestamp_filter_start", "cookie_timestamp_filter_end")
KINDS = {"$": "counter", "#": "set", "&": "multiset", "^": "hll"}


class ParseError(ValueError):
    """A program that can't be run, with the line and position where that shows."""

    def __init__(self, message: str, line: int | None = None, position: int | None = None):
        where = "" if line is None else f" (line {line}" + ("" if position is None else f", position {position}") + ")"
        super().__init__(message + where)
        self.message, self.line, self.position = message, line, position


@dataclass(frozen=True)
class Param:
    """A value given from outside: by the parameters or by foreach. The name keeps its sigil."""

    name: str


@dataclass(frozen=True)
class Condition:
    field: str
    op: str  # = in < <= > >=
    operand: str | int | Param


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class WindowStart:
    block: int | None  # None: the block itself


@dataclass(frozen=True)
class Literal:
    value: str | int


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


Term = Field | WindowStart | Literal | Param | Call


@dataclass(frozen=True)
class Yield:
    target: str
    terms: tuple[Term, ...] = ()

    @property
    def kind(self) -> str:
        return KINDS[self.target[0]]


@dataclass(frozen=True)
class Move:
    kind: str  # repeat, quit; next and here go to a block with or without taking the event
    block: int | None = None


@dataclass(frozen=True)
class Clause:
    conditions: tuple[Condition, ...]
    yields: tuple[Yield, ...]
    move: Move
    negated: bool = False
    line: int | None = None


@dataclass(frozen=True)
class After:
    yields: tuple[Yield, ...]
    move: Move


@dataclass(frozen=True)
class Block:
    index: int
    name: str
    clauses: tuple[Clause, ...]
    duration: int | None
    after: After
    windows: tuple[int, ...]  # enclosing windows, outermost first
    is_window: bool = False


@dataclass(frozen=True)
class Foreach:
    variables: tuple[str, ...]
    array: str | None  # None: the values of the field that the variable is compared with
    merged: bool = False


@dataclass(frozen=True)
class Program:
    blocks: tuple[Block, ...]
    foreach: Foreach | None = None
    entry: int = 0
    warnings: tuple[str, ...] = field(default=())

    @cached_property
    def edges(self) -> list[tuple[Block, Clause | After]]:
        return [(b, e) for b in self.blocks for e in (*b.clauses, b.after)]

    @cached_property
    def yields(self) -> list[Yield]:
        return [y for _, e in self.edges for y in e.yields]

    @cached_property
    def results(self) -> dict[str, str]:
        """Result variables in order of appearance, with their kinds."""
        return {y.target: y.kind for y in self.yields}

    @cached_property
    def conditions(self) -> list[Condition]:
        return [c for b in self.blocks for clause in b.clauses for c in clause.conditions]

    @cached_property
    def bound(self) -> tuple[str, ...]:
        return self.foreach.variables if self.foreach else ()

    @cached_property
    def terms(self) -> list[Term]:
        def flat(t: Term):
            yield t
            for a in t.args if isinstance(t, Call) else ():
                yield from flat(a)

        return [x for y in self.yields for t in y.terms for x in flat(t)]

    @cached_property
    def fields(self) -> list[str]:
        """Event fields that the program looks at: all that a scan has to read."""
        names = [c.field for c in self.conditions] + [t.name for t in self.terms if isinstance(t, Field)]
        return [n for n in dict.fromkeys(names) if n not in SPECIAL]

    @cached_property
    def free(self) -> list[str]:
        """Parameters that foreach doesn't bind."""
        names = [c.operand.name for c in self.conditions if isinstance(c.operand, Param)] + [t.name for t in self.terms if isinstance(t, Param)]
        return [n for n in dict.fromkeys(names) if n not in self.bound]

    @cached_property
    def functions(self) -> list[str]:
        return list(dict.fromkeys(t.name for t in self.terms if isinstance(t, Call)))

    def variable_fields(self, name: str) -> list[str]:
        return list(dict.fromkeys(c.field for c in self.conditions if isinstance(c.operand, Param) and c.operand.name == name))

    def depth(self, index: int) -> int:
        return len(self.blocks[index].windows)

    def validate(self) -> Program:
        if not self.blocks:
            raise ParseError("A program needs a block")
        names = [b.name for b in self.blocks if b.name]
        for name in names:
            if names.count(name) > 1:
                raise ParseError(f"Two blocks are called {name}")
        for b, e in self.edges:
            self._check_edge(b, e)
        for v in self.bound:
            if v[0] not in "%#":
                raise ParseError(f"foreach can't bind {v}")
        if self.foreach and self.foreach.array is None:
            if len(self.bound) != 1 or self.bound[0][0] != "%":
                raise ParseError("foreach without an array takes one scalar variable")
            if len([f for f in self.variable_fields(self.bound[0]) if f != "timestamp"]) != 1:
                raise ParseError(f"{self.bound[0]} has to be compared with one field, whose values foreach goes through")
        self._check_cascades()
        return self

    def _check_edge(self, b: Block, e: Clause | After) -> None:
        line = getattr(e, "line", None)
        if isinstance(e, After) and e.move.kind == "repeat":
            raise ParseError(f"after can't repeat, in {b.name}", line)
        if e.move.block is not None:
            if not 0 <= e.move.block < len(self.blocks):
                raise ParseError(f"{b.name} goes to block {e.move.block}, which isn't there", line)
            there = self.blocks[e.move.block].windows
            if b.windows[: len(there)] != there:
                raise ParseError(f"{b.name} can't go into a window from outside: {self.blocks[e.move.block].name}", line)
        for c in e.conditions if isinstance(e, Clause) else ():
            if c.op not in ("=", "in") and c.field != "timestamp":
                raise ParseError(f"{c.op} compares timestamps only, not {c.field}", line)
            if c.op == "in" and not (isinstance(c.operand, Param) and c.operand.name[0] == "#"):
                raise ParseError(f"{c.field} in takes a set parameter", line)
            if c.op != "in" and isinstance(c.operand, Param) and c.operand.name[0] != "%":
                raise ParseError(f"{c.operand.name} is no scalar parameter", line)
        for y in e.yields:
            if (y.kind == "counter") == bool(y.terms):
                raise ParseError(f"{y.target} takes {'no' if y.kind == 'counter' else 'some'} values", line)
            for t in y.terms:
                self._check_term(b, t, line)

    def _check_term(self, b: Block, t: Term, line: int | None) -> None:
        if isinstance(t, Call):
            for a in t.args:
                self._check_term(b, a, line)
        elif isinstance(t, WindowStart):
            if t.block is not None and t.block not in (*b.windows, *([b.index] if b.is_window else [])):
                raise ParseError(f"start_timestamp[{self.blocks[t.block].name}] is used outside that window", line)
            if self.blocks[b.index if t.block is None else t.block].duration is None:
                raise ParseError("start_timestamp needs a block with a duration", line)

    def inner(self, index: int) -> int:
        """The first block that can wait for events, at or after a window's start."""
        while self.blocks[index].is_window:
            index += 1
        return index

    def _check_cascades(self) -> None:
        """Timeouts that lead to each other without time passing would never end."""
        for b in self.blocks:
            seen, at = set(), b
            while at.duration == 0 and at.after.move.kind == "here":
                if at.index in seen:
                    raise ParseError(f"after 0s goes round in circles at {at.name}")
                seen.add(at.index)
                at = self.blocks[self.inner(at.after.move.block)]
