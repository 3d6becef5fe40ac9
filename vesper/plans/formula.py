"""Formulas of signal temporal logic as hash-consed trees.

Equal formulas are one object, so a planner that keeps a column per node evaluates shared parts once, however
often a formula repeats them. Times are seconds in a formula and whole microseconds in plans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import ClassVar

MICROS = 1_000_000


def micros(seconds: float) -> int:
    return round(seconds * MICROS)


def number(x: float) -> str:
    """As floats are shown: whole ones without a fraction."""
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e16 else repr(float(x))


#: Begins the name of a signal that is an expression over others.
DERIVED = "="
# Words of SQL expressions that are no signals.
WORDS = {"and", "as", "bigint", "case", "cast", "double", "else", "end", "false", "float", "int", "integer", "is", "not", "null", "or", "then", "true", "when"}
NAME = re.compile(r"[A-Za-z_]\w*(?!\w)(?!\s*\()")


def expression_signals(name: str) -> list[str]:
    return sorted({w for w in NAME.findall(name) if w.lower() not in WORDS})


def expression_over(name: str, columns: dict[str, str]) -> str:
    """The expression's SQL with columns for its signals, where all of them are there."""
    said = NAME.sub(lambda m: columns.get(m[0], m[0]), name.removeprefix(DERIVED))
    there = " and ".join(f"{columns[n]} is not null" for n in expression_signals(name))
    return f"case when {there} then cast({said} as double) end"


class Formula:
    """A node: kind, its scalar arguments, and its operands. Build with the class methods or by parsing."""

    __slots__ = ("args", "depth", "key", "kind", "parts")
    _made: ClassVar[dict] = {}

    def __new__(cls, kind: str, args: tuple = (), parts: tuple = ()):
        at = (kind, args, tuple(p.key for p in parts))
        if (known := cls._made.get(at)) is not None:
            return known
        node = super().__new__(cls)
        node.kind, node.args, node.parts, node.key = kind, args, parts, len(cls._made)
        below = max((p.depth for p in parts), default=0)
        node.depth = below + (micros(args[1]) if kind in ("always", "eventually", "until") else 0)
        cls._made[at] = node
        return node

    def __reduce__(self):
        return Formula, (self.kind, self.args, self.parts)

    # Atoms
    @staticmethod
    def gt(signal: str, value: float) -> Formula:
        return Formula("gt", (str(signal), float(value)))

    @staticmethod
    def lt(signal: str, value: float) -> Formula:
        return Formula("lt", (str(signal), float(value)))

    @staticmethod
    def gt_var(signal: str, variable: str) -> Formula:
        return Formula("gt_var", (str(signal), variable.removeprefix("$")))

    @staticmethod
    def lt_var(signal: str, variable: str) -> Formula:
        return Formula("lt_var", (str(signal), variable.removeprefix("$")))

    @staticmethod
    def true_() -> Formula:
        return Formula("true")

    @staticmethod
    def false_() -> Formula:
        return Formula("false")

    @staticmethod
    def pred(expression: str, comparison: str, value: float) -> Formula:
        """A comparison of a SQL expression over signals, such as ``pred("speed * 0.5 + drift", ">", 3)``; its names are signals."""
        if comparison not in (">", "<", ">=", "<=", "=="):
            raise ValueError("Invalid comparison. Use '>', '<', '>=', '<=', or '=='")
        name = DERIVED + " ".join(expression.split())
        if not expression_signals(name):
            raise ValueError(f"No signal in '{expression}'")
        make = {">": Formula.gt, "<": Formula.lt, ">=": Formula.ge, "<=": Formula.le, "==": Formula.eq}[comparison]
        return make(name, value)

    # Sugar
    @staticmethod
    def ge(signal: str, value: float) -> Formula:
        return Formula.not_(Formula.lt(signal, value))

    @staticmethod
    def le(signal: str, value: float) -> Formula:
        return Formula.not_(Formula.gt(signal, value))

    @staticmethod
    def eq(signal: str, value: float) -> Formula:
        return Formula.and_(Formula.le(signal, value), Formula.ge(signal, value))

    # Connectives
    @staticmethod
    def not_(child: Formula) -> Formula:
        return Formula("not", (), (child,))

    @staticmethod
    def and_(left: Formula, right: Formula) -> Formula:
        return Formula("and", (), (left, right))

    @staticmethod
    def or_(left: Formula, right: Formula) -> Formula:
        return Formula("or", (), (left, right))

    @staticmethod
    def implies(left: Formula, right: Formula) -> Formula:
        return Formula("implies", (), (left, right))

    # Temporal operators
    @staticmethod
    def _within(start: float, end: float) -> tuple[float, float]:
        if start < 0 or end < 0:
            raise ValueError("Interval bounds must be non-negative")
        if start > end:
            raise ValueError(f"Invalid interval: start ({number(start)}) is after end ({number(end)})")
        return float(start), float(end)

    @staticmethod
    def always(start: float, end: float, child: Formula) -> Formula:
        return Formula("always", Formula._within(start, end), (child,))

    @staticmethod
    def eventually(start: float, end: float, child: Formula) -> Formula:
        return Formula("eventually", Formula._within(start, end), (child,))

    @staticmethod
    def until(start: float, end: float, left: Formula, right: Formula) -> Formula:
        return Formula("until", Formula._within(start, end), (left, right))

    globally = always

    def __and__(self, other: Formula) -> Formula:
        return Formula.and_(self, other)

    def __or__(self, other: Formula) -> Formula:
        return Formula.or_(self, other)

    def __invert__(self) -> Formula:
        return Formula.not_(self)

    def __rshift__(self, other: Formula) -> Formula:
        return Formula.implies(self, other)

    def walk(self) -> Iterator[Formula]:
        """Each distinct node once, operands first."""
        seen: set[int] = set()

        def go(node: Formula) -> Iterator[Formula]:
            if node.key not in seen:
                seen.add(node.key)
                for p in node.parts:
                    yield from go(p)
                yield node

        yield from go(self)

    def signals(self) -> list[str]:
        return sorted({n.args[0] for n in self.walk() if n.kind in ("gt", "lt", "gt_var", "lt_var")})

    def bases(self) -> list[str]:
        """The signals that are sampled: signals(), with those of expressions instead of the expressions."""
        return sorted({b for n in self.signals() for b in (expression_signals(n) if n.startswith(DERIVED) else [n])})

    def derived(self) -> list[str]:
        """The expressions over signals."""
        return [n for n in self.signals() if n.startswith(DERIVED)]

    def variables(self) -> list[str]:
        return sorted({n.args[1] for n in self.walk() if n.kind in ("gt_var", "lt_var")})

    get_signal_identifiers, get_variable_identifiers = signals, variables

    def bound(self, values: dict[str, float]) -> Formula:
        """With variables replaced by their values where these are given."""
        if self.kind in ("gt_var", "lt_var"):
            return Formula(self.kind[:2], (self.args[0], float(values[self.args[1]]))) if self.args[1] in values else self
        return Formula(self.kind, self.args, tuple(p.bound(values) for p in self.parts)) if self.parts else self

    def __str__(self) -> str:
        inside = [str(p) for p in self.parts]
        span = "[{}, {}]".format(*map(number, self.args)) if self.kind in ("always", "eventually", "until") else ""
        match self.kind:
            case "true" | "false":
                return self.kind.capitalize()
            case "gt" | "lt":
                return f"{self.args[0].removeprefix(DERIVED)} {'>' if self.kind == 'gt' else '<'} {number(self.args[1])}"
            case "gt_var" | "lt_var":
                return f"{self.args[0]} {'>' if self.kind == 'gt_var' else '<'} ${self.args[1]}"
            case "not":
                return f"¬({inside[0]})"
            case "always" | "eventually":
                return f"{'G' if self.kind == 'always' else 'F'}{span}({inside[0]})"
            case "until":
                return f"({inside[0]}) U{span} ({inside[1]})"
        return f"({inside[0]}) {dict(zip(('and', 'or', 'implies'), '∧v→', strict=True))[self.kind]} ({inside[1]})"

    def __repr__(self) -> str:
        return f"Formula({self})"

    def tree(self, indent: int = 0) -> str:
        """A line per node, drawn with branches; repeated parts are drawn each time."""
        words = {"true": "True", "false": "False", "not": "Not", "and": "And", "or": "Or", "implies": "Implies", "always": "Globally", "eventually": "Eventually", "until": "Until"}

        def label(node: Formula) -> str:
            span = "[{},{}]".format(*map(number, node.args)) if node.kind in ("always", "eventually", "until") else ""
            return words[node.kind] + span if node.kind in words else str(node)

        lines = [label(self)]

        def below(node: Formula, lead: str) -> None:
            for i, p in enumerate(node.parts):
                last = i == len(node.parts) - 1
                lines.append(f"{lead}{'└── ' if last else '├── '}{label(p)}")
                below(p, lead + ("    " if last else "│   "))

        below(self, "    ")
        return "\n".join(" " * indent + x for x in lines)

    to_tree_string = tree


def margins(node: Formula) -> Formula:
    """The formula with ``s > $v`` as a comparison of the signal ``s-$v``, a sample's distance from the value that v had when it came."""
    if node.kind in ("gt_var", "lt_var"):
        return Formula(node.kind[:2], (f"{node.args[0]}-${node.args[1]}", 0.0))
    return Formula(node.kind, node.args, tuple(margins(p) for p in node.parts)) if node.parts else node


def normalize(node: Formula) -> Formula:
    """Implications as disjunctions, no double negation, and constants folded where rows stay the same.

    ``true and f`` is ``f`` only if f's rows are those of all signals; so constants fold with constants alone.
    """
    parts = tuple(normalize(p) for p in node.parts)
    kinds = tuple(p.kind for p in parts)
    match node.kind:
        case "implies":
            return normalize(Formula("or", (), (Formula("not", (), (parts[0],)), parts[1])))
        case "not" if kinds[0] == "not":
            return parts[0].parts[0]
        case "not" if kinds[0] in ("true", "false"):
            return Formula("false" if kinds[0] == "true" else "true")
        case "and" | "or" if set(kinds) <= {"true", "false"}:
            rule = all if node.kind == "and" else any
            return Formula("true" if rule(k == "true" for k in kinds) else "false")
        case "and" | "or" if parts[0] is parts[1]:
            return parts[0]
    return Formula(node.kind, node.args, parts) if parts else node
