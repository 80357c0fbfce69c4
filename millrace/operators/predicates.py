"""Predicates as small trees that compile to one Column. SQL's three-valued logic unless two-valued NOT is asked for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = int | float | str | None
Resolve = Callable[[str], Column]


class Predicate:
    def columns(self) -> set[str]:
        raise NotImplementedError

    def compile(self, of: Resolve, two_valued: bool = False) -> Column:
        raise NotImplementedError

    def pretty(self) -> str:
        """Canonical text: the same predicates under AND or OR have the same text in any order."""
        raise NotImplementedError

    def __and__(self, other: Predicate) -> Predicate:
        return Logic("AND", (self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Logic("OR", (self, other))

    def __invert__(self) -> Predicate:
        return Logic("NOT", (self,))


def literal(v: Value) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


_COMPARE = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v,
    ">": lambda c, v: c > v, "<=": lambda c, v: c <= v, ">=": lambda c, v: c >= v,
}


def like(c: Column, pattern: str) -> Column:
    """LIKE without an escape character: a backslash stands for itself, so Spark's own escape is doubled."""
    return c.like(pattern.replace("\\", "\\\\"))


@dataclass(frozen=True)
class Compare(Predicate):
    """column op value; op is a comparison, LIKE, NOT LIKE, IS NULL, IS NOT NULL, BETWEEN or IN (value: a tuple)."""

    column: str
    op: str
    value: object = None

    def columns(self) -> set[str]:
        return {self.column}

    def compile(self, of: Resolve, two_valued: bool = False) -> Column:
        c = of(self.column)
        if self.op == "IS NULL":
            return c.isNull()
        if self.op == "IS NOT NULL":
            return c.isNotNull()
        if self.op == "LIKE":
            out = like(c, self.value)
        elif self.op == "NOT LIKE":
            out = ~like(c, self.value)
        elif self.op == "BETWEEN":
            out = c.between(*self.value)
        elif self.op == "IN":
            out = c.isin(*self.value)
        elif self.op in _COMPARE:
            out = _COMPARE[self.op](c, F.lit(self.value))
        else:
            raise ValueError(f"unknown operator {self.op}")
        return F.coalesce(out, F.lit(False)) if two_valued else out

    def pretty(self) -> str:
        if self.op.endswith("NULL"):
            return f"({self.column} {self.op})"
        if self.op == "BETWEEN":
            return f"({self.column} BETWEEN {literal(self.value[0])} AND {literal(self.value[1])})"
        if self.op == "IN":
            return f"({self.column} IN ({', '.join(map(literal, self.value))}))"
        return f"({self.column} {self.op} {literal(self.value)})"


@dataclass(frozen=True)
class Logic(Predicate):
    op: str
    parts: tuple[Predicate, ...]

    def columns(self) -> set[str]:
        return set().union(*(p.columns() for p in self.parts))

    def compile(self, of: Resolve, two_valued: bool = False) -> Column:
        first, *rest = (p.compile(of, two_valued) for p in self.parts)
        if self.op == "NOT":
            return ~first
        for x in rest:
            first = first & x if self.op == "AND" else first | x
        return first

    def pretty(self) -> str:
        if self.op == "NOT":
            return f"(NOT {self.parts[0].pretty()})"
        flat = [p for x in self.parts for p in (x.parts if isinstance(x, Logic) and x.op == self.op else (x,))]
        return "(" + f" {self.op} ".join(sorted({p.pretty() for p in flat})) + ")"
