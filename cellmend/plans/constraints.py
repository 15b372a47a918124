"""Denial constraints: the language, its syntax tree, and its Column expressions.

    constraint := tuple ('&' tuple)? ('&' predicate)+
    predicate  := OP '(' operand ',' operand ')'
    OP         := EQ | IQ | LT | GT | LTE | GTE
    operand    := tuple '.' attribute | 'text' | "text"

A constraint says that no tuple, or pair of different tuples, satisfies all its predicates.
A text is the right operand only; attribute names with special characters are put in back-quotes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The operators and their SQL forms.
OPERATORS = {"EQ": "=", "IQ": "<>", "LT": "<", "GT": ">", "LTE": "<=", "GTE": ">="}
_APPLY: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b,
    ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}
_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


class ConstraintError(ValueError):
    """A constraint that cannot be read, or does not fit the table."""


def is_symmetric(op: str) -> bool:
    return op in ("=", "<>")


def flip(op: str) -> str:
    """The operator that holds with its operands exchanged."""
    return _FLIP.get(op, op)


@dataclass(frozen=True)
class Attribute:
    tuple: str
    name: str


@dataclass(frozen=True)
class Literal:
    value: str


@dataclass(frozen=True)
class Predicate:
    op: str
    left: Attribute
    right: Attribute | Literal

    @property
    def tuples(self) -> frozenset[str]:
        return frozenset(o.tuple for o in (self.left, self.right) if isinstance(o, Attribute))

    def column(self, of: Callable[[Attribute], Column]) -> Column:
        right = of(self.right) if isinstance(self.right, Attribute) else F.lit(self.right.value)
        return _APPLY[self.op](of(self.left), right)

    def sql(self) -> str:
        show = lambda o: f'{o.tuple}."{o.name}"' if isinstance(o, Attribute) else "'" + o.value.replace("'", "''") + "'"
        return f"{show(self.left)}{self.op}{show(self.right)}"


@dataclass(frozen=True)
class Constraint:
    tuples: tuple[str, ...]
    predicates: tuple[Predicate, ...]

    @property
    def components(self) -> list[str]:
        """The attributes whose cells a violation makes suspicious: each predicate's left one."""
        return list(dict.fromkeys(p.left.name for p in self.predicates))

    def sql(self) -> str:
        return " AND ".join(p.sql() for p in self.predicates)


def apply(op: str, left: Column, right: Column) -> Column:
    return _APPLY[op](left, right)


_TOKEN = re.compile(r"""\s*(?:(?P<text>'[^']*'|"[^"]*")|(?P<name>`[^`]+`)|(?P<mark>[&(),.])|(?P<word>[^&(),.'"`\s][^&(),.'"`]*))""")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ConstraintError(f"cannot read {text[at:]!r} in {text!r}; is a literal not closed?")
        kind = m.lastgroup or ""
        value = m[kind]
        out.append((kind, value[1:-1] if kind in ("text", "name") else value.rstrip()))
        at = m.end()
    return out


def parse(text: str, schema: list[str] | None = None) -> Constraint:
    """Read a constraint; attributes are checked against ``schema`` if it is given."""
    parts: list[list[tuple[str, str]]] = [[]]
    for token in _tokens(text):
        if token == ("mark", "&"):
            parts.append([])
        else:
            parts[-1].append(token)
    tuples: list[str] = []
    predicates: list[Predicate] = []
    for part in parts:
        if len(part) == 1 and part[0][0] == "word":
            if part[0][1] in OPERATORS:
                raise ConstraintError(f"{part[0][1]} has no operands in {text!r}")
            tuples.append(part[0][1])
        else:
            predicates.append(_predicate(part, tuples, schema, text))
    if not predicates:
        raise ConstraintError(f"no predicate in {text!r}")
    if not 1 <= len(tuples) <= 2 or len(set(tuples)) != len(tuples):
        raise ConstraintError(f"one or two different tuples are needed in {text!r}")
    return Constraint(tuple(tuples), tuple(predicates))


def _predicate(part, tuples, schema, text) -> Predicate:
    if len(part) < 3 or part[0][0] != "word" or part[0][1] not in OPERATORS:
        raise ConstraintError(f"a predicate begins with one of {', '.join(OPERATORS)}: {text!r}")
    if part[1] != ("mark", "(") or part[-1] != ("mark", ")"):
        raise ConstraintError(f"operands stand in one pair of brackets: {text!r}")
    operands: list[list[tuple[str, str]]] = [[]]
    for token in part[2:-1]:
        if token == ("mark", ","):
            operands.append([])
        else:
            operands[-1].append(token)
    if len(operands) != 2:
        raise ConstraintError(f"a predicate has two operands, not {len(operands)}: {text!r}")
    left, right = (_operand(o, tuples, schema, text) for o in operands)
    if isinstance(left, Literal):
        raise ConstraintError(f"a literal is the right operand only: {text!r}")
    return Predicate(OPERATORS[part[0][1]], left, right)


def _operand(tokens, tuples, schema, text) -> Attribute | Literal:
    if len(tokens) == 1 and tokens[0][0] == "text":
        return Literal(tokens[0][1])
    if len(tokens) >= 3 and tokens[0][0] == "word" and tokens[1] == ("mark", ".") and all(k in ("word", "name") for k, _ in tokens[2:]) and len(tokens) == 3:
        name, attribute = tokens[0][1], tokens[2][1]
        if name not in tuples:
            raise ConstraintError(f"tuple {name!r} is not declared in {text!r}")
        if schema is not None and attribute not in schema:
            raise ConstraintError(f"attribute {attribute!r} of {text!r} is not in the table")
        return Attribute(name, attribute)
    raise ConstraintError(f"an operand is tuple.attribute or a quoted text: {text!r}")
