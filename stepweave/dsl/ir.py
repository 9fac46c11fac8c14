"""Programs as JSON: flat rules with numbered transitions.

    {"rules": [{"name", "n", "clauses", "window", "after", "outer", "entrypoint"}],
     "groupby": {"vars", "values", "merge_results"}}

A clause has attrs (field: conditions), op ("not"), yield and action; a rule
with "outer" is a window over the rules up to that number.
"""

from __future__ import annotations

import re

from .program import After, Block, Call, Clause, Condition, Field, Foreach, Literal, Move, Param, ParseError, Program, Term, WindowStart, Yield

_ACTION = re.compile(r"(repeat|quit|stop|break|restart-from-(?:here|next|start))(?:\((\d+)\))?")
_COMPARE = re.compile(r"(<=|>=|==|<|>)(.+)")


def from_ir(ir: dict) -> Program:
    rules = ir["rules"]
    names = [r.get("name") or f"block{i}" for i, r in enumerate(rules)]
    windows = [tuple(w for w in range(i) if rules[w].get("outer") and w < i < rules[w]["outer"]) for i in range(len(rules))]
    blocks = []
    for i, r in enumerate(rules):
        clauses = tuple(Clause(_conditions(c.get("attrs", {})), _yields(c, names), _move(c.get("action"), i, "clause"), c.get("op") == "not", c.get("lineno")) for c in r.get("clauses", []))
        after = r.get("after") or {}
        blocks.append(Block(i, names[i], clauses, r.get("window"), After(_yields(after, names), _move(after.get("action"), i, "after")), windows[i], bool(r.get("outer"))))
    entry = next((i for i, r in enumerate(rules) if r.get("entrypoint")), 0)
    g = ir.get("groupby")
    foreach = Foreach(tuple(g["vars"]), g.get("values"), bool(g.get("merge_results"))) if g else None
    return Program(tuple(blocks), foreach, entry).validate()


def _conditions(attrs: dict) -> tuple[Condition, ...]:
    found = []
    for name, conditions in attrs.items():
        for text in conditions:
            m = _COMPARE.fullmatch(text)
            op, value = (m[1], m[2]) if m else ("=", text)
            op = "=" if op == "==" else op
            if value[:1] in ("%", "#", "&"):
                found.append(Condition(name, "in" if value[0] != "%" else op, Param(value)))
            else:
                found.append(Condition(name, op, int(value) if name == "timestamp" else value))
    return tuple(found)


def _yields(edge: dict, names: list[str]) -> tuple[Yield, ...]:
    def term(t: dict) -> Term:
        kind = t["_k"]
        if kind == "window_ref":
            if t.get("ref") is not None and t["ref"] not in names:
                raise ParseError(f"Label not found: {t['ref']}")
            return WindowStart(None if t.get("ref") is None else names.index(t["ref"]))
        if kind == "fcall":
            return Call(t["name"], tuple(map(term, t["args"])))
        return Field(t["name"]) if kind == "field" else Param(t["name"]) if kind == "param" else Literal(t["value"])

    return tuple(Yield(y["dst"], tuple(map(term, y.get("src", ())))) for y in edge.get("yield") or ())


def _move(action: str | None, index: int, where: str) -> Move:
    m = _ACTION.fullmatch(action or "restart-from-here")
    if not m or m[1] == "restart-from-start":
        raise ParseError(f"Not supported: {action}")
    if m[1] == "repeat":
        return Move("repeat")
    if m[1] in ("quit", "stop"):
        return Move("quit")
    if m[1] == "break":
        return Move("next", index + 1)
    return Move("here" if m[1] == "restart-from-here" else "next", int(m[2] or 0))


def to_ir(program: Program) -> dict:
    def term(t: Term) -> dict:
        if isinstance(t, WindowStart):
            return {"_k": "window_ref"} | ({} if t.block is None else {"ref": program.blocks[t.block].name})
        if isinstance(t, Call):
            return {"_k": "fcall", "name": t.name, "args": [term(a) for a in t.args]}
        return {"_k": "literal", "value": t.value} if isinstance(t, Literal) else {"_k": "param" if isinstance(t, Param) else "field", "name": t.name}

    def edge(e: Clause | After) -> dict:
        move = {"repeat": "repeat", "quit": "quit", "here": f"restart-from-here({e.move.block})", "next": f"restart-from-next({e.move.block})"}[e.move.kind]
        out: dict = {"action": move}
        if e.yields:
            out["yield"] = [{"dst": y.target} | ({"src": [term(t) for t in y.terms]} if y.terms else {}) for y in e.yields]
        return out

    def clause(c: Clause) -> dict:
        attrs: dict[str, list[str]] = {}
        for x in c.conditions:
            value = x.operand.name if isinstance(x.operand, Param) else str(x.operand)
            attrs.setdefault(x.field, []).append(value if x.op in ("=", "in") else x.op + value)
        return {"attrs": attrs} | edge(c) | ({"op": "not"} if c.negated else {}) | ({} if c.line is None else {"lineno": c.line})

    rules = []
    for b in program.blocks:
        rule: dict = {"name": b.name, "n": b.index, "after": edge(b.after)}
        if b.duration is not None:
            rule["window"] = b.duration
        if b.is_window:
            rule["outer"] = 1 + max((x.index for x in program.blocks if b.index in x.windows), default=b.index)
        else:
            rule["clauses"] = [clause(c) for c in b.clauses]
        if b.index == program.entry and b.index:
            rule["entrypoint"] = True
        rules.append(rule)
    out: dict = {"rules": rules}
    if program.foreach:
        g = program.foreach
        out["groupby"] = {"vars": list(g.variables)} | ({"values": g.array} if g.array else {}) | ({"merge_results": True} if g.merged else {})
    return out
