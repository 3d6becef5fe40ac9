"""The 21 benchmark formulas, by rule: atoms and pairs, windows of three lengths, and chains of three depths."""

from __future__ import annotations

from .formula import Formula
from .parser import parse_stl

# Bounds of the window-scaled formulas and depths of the chains.
BOUNDS, DEPTHS, SPAN = (10, 100, 1000), (2, 3, 5), (0, 10)
PLAIN = ("x < 0.5 and x > -0.5", "x < 0.5 or x > -0.5", "not(x < 0.5)")
SCALED = ("G[0,{b}](x < 0.5)", "F[0,{b}](x < 0.5)", "(x < 0.5) until[0,{b}] (x > -0.5)")
CHAINS = (
    lambda f: Formula.and_(Formula.eventually(*SPAN, f), Formula.eventually(*SPAN, f)),
    lambda f: Formula.eventually(*SPAN, Formula.always(*SPAN, f)),
    lambda f: Formula.until(*SPAN, f, f),
)


def chain(link, depth: int) -> Formula:
    found = Formula.gt("x", 0.0)
    for _ in range(depth):
        found = link(found)
    return found


def get_formulas(ids: list[int] | tuple[int, ...] = ()) -> list[tuple[int, Formula]]:
    made = [parse_stl(s) for s in PLAIN]
    made += [parse_stl(s.format(b=b)) for s in SCALED for b in BOUNDS]
    made += [chain(link, depth) for link in CHAINS for depth in DEPTHS]
    return [(i, f) for i, f in enumerate(made, 1) if not ids or i in ids]
