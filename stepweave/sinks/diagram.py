"""A program's machine as Graphviz text."""

from __future__ import annotations

from ..dsl.program import After, Clause, Param, Program


def _label(edge: Clause | After, duration: int | None) -> str:
    if isinstance(edge, After):
        text = "after" + (f" {duration}s" if duration is not None else "")
    else:
        text = ", ".join(f"{c.field} {c.op} {c.operand.name if isinstance(c.operand, Param) else repr(c.operand)}" for c in edge.conditions) or "*"
        text = f"not ({text})" if edge.negated else text
    return text + "".join(f"\\nyield {y.target}" for y in edge.yields)


def to_dot(program: Program) -> str:
    if program.foreach:
        raise ValueError("the diagram shows programs without foreach")
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\\\\n", "\\n") + '"'
    lines = ["digraph program {"]
    for b in program.blocks:
        lines.append(f"  {quote(b.name)} [shape={'box' if b.is_window else 'ellipse'}{', peripheries=2' if b.index == program.entry else ''}];")
    lines.append('  "quit" [shape=point];')
    for b, e in program.edges:
        there = b.name if e.move.kind == "repeat" else "quit" if e.move.kind == "quit" else program.blocks[e.move.block].name
        lines.append(f"  {quote(b.name)} -> {quote(there)} [label={quote(_label(e, b.duration))}];")
    return "\n".join([*lines, "}"])
