"""Predicates in conjunctive normal form: ``(a < 1 OR b = 'x') AND (c = d)``.

The parsed form is a value; ``to_column`` binds it to a DataFrame's columns. ``x = x`` selects everything,
null included, so it becomes a true literal. With strict typing, both sides of a comparison must have one
of the three types of the catalog alike; otherwise Spark's coercion applies.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.functions.lexer import PREDICATE, Cursor, ParseError

KINDS = {"int": "Int", "float": "Double", "string": "String"}


@dataclass(frozen=True)
class Operand:
    kind: str  # name, int, float or string
    text: str

    @property
    def value(self) -> int | float | str:
        return int(self.text) if self.kind == "int" else float(self.text) if self.kind == "float" else self.text

    def __str__(self) -> str:
        return f"'{self.text}'" if self.kind == "string" else self.text


@dataclass(frozen=True)
class Comparison:
    left: Operand
    op: str
    right: Operand

    @property
    def names(self) -> list[str]:
        return [o.text for o in (self.left, self.right) if o.kind == "name"]

    @property
    def always(self) -> bool:
        """Is it ``x = x``?"""
        return self.op == "=" and self.left == self.right

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


Clause = tuple[Comparison, ...]


@dataclass(frozen=True)
class CNF:
    clauses: tuple[Clause, ...]

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(n for c in self.clauses for x in c for n in x.names))

    def __str__(self) -> str:
        return " AND\n".join(f"( {' OR '.join(map(str, c))} )" for c in self.clauses)


def parse(text: str) -> CNF:
    c = Cursor(text, PREDICATE)
    clauses = [_clause(c)]
    while c.kind == "AND":
        c.take("AND")
        clauses.append(_clause(c))
    c.take("end")
    return CNF(tuple(clauses))


def _clause(c: Cursor) -> Clause:
    c.take("(")
    out = [_comparison(c)]
    while c.kind == "OR":
        c.take("OR")
        out.append(_comparison(c))
    c.take(")")
    return tuple(out)


def _comparison(c: Cursor) -> Comparison:
    left = _operand(c)
    if c.kind in (")", "OR") and left.kind == "name":  # a bare attribute spells a sort key
        return Comparison(left, "=", left)
    op = c.take("<", ">", "=").kind
    return Comparison(left, op, _operand(c))


def _operand(c: Cursor) -> Operand:
    t = c.take("name", "int", "float", "string")
    return Operand(t.kind, t.text)


def sort_keys(text: str) -> list[str]:
    """Attributes of an order spelt ``(a) AND (b)``."""
    clauses = parse(text).clauses
    if any(len(c) != 1 or not c[0].always for c in clauses):
        raise ParseError(f"not a sort order: {text!r}")
    return [c[0].left.text for c in clauses]


def type_name(kind: T.DataType) -> str:
    """Catalog type of a Spark type."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "Int"
    if isinstance(kind, T.NumericType):
        return "Double"
    return "String"


def _check(x: Comparison, schema: T.StructType) -> None:
    def of(o: Operand) -> str:
        if o.kind != "name":
            return KINDS[o.kind]
        found = [f for f in schema.fields if f.name in (o.text, o.text.split(".")[-1])]
        if not found:
            raise ParseError(f"no attribute {o.text!r}")
        return type_name(found[0].dataType)

    if of(x.left) != of(x.right):
        raise TypeError(f"{x}: {of(x.left)} against {of(x.right)}")


def comparison_column(x: Comparison) -> Column:
    if x.always:
        return F.lit(True)
    left, right = (F.col(o.text) if o.kind == "name" else F.lit(o.value) for o in (x.left, x.right))
    return {"<": left < right, ">": left > right, "=": left == right}[x.op]


def to_column(cnf: CNF | str, schema: T.StructType | None = None, strict: bool = False) -> Column:
    """The predicate over columns of the same (perhaps qualified) names; strict typing needs the schema."""
    cnf = parse(cnf) if isinstance(cnf, str) else cnf
    if strict:
        for x in (x for c in cnf.clauses for x in c):
            _check(x, schema)
    clauses = [reduce(Column.__or__, map(comparison_column, c)) for c in cnf.clauses if not any(x.always for x in c)]
    return reduce(Column.__and__, clauses, F.lit(True))


def bound_text(cnf: CNF, left: T.StructType, right: T.StructType | None = None) -> str:
    """Each comparison by the places of its attributes; names are looked up on the left first."""
    literals = 0

    def side(o: Operand) -> tuple[str, str]:
        nonlocal literals
        if o.kind != "name":
            literals += 1
            return f"Att {literals - 1} from literal record", KINDS[o.kind]
        for where, schema in (("left", left), ("right", right)):
            if schema is not None and o.text in schema.names:
                k = schema.names.index(o.text)
                return f"Att {k} from {where} record", type_name(schema[k].dataType)
        raise ParseError(f"no attribute {o.text!r}")

    def one(x: Comparison) -> str:
        (a, kind), (b, _) = side(x.left), side(x.right)
        return f"{a} {x.op} {b} ({kind})"

    return " AND\n".join(f"( {' OR '.join(map(one, c))} )" for c in cnf.clauses)
