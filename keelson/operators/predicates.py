"""Typed comparisons of a field with a value, joined by AND.

Default semantics are SQL's: every predicate has its own value, nulls are unknown, NaN equals NaN and is the largest.
`compat` reproduces the record store's: of predicates with the same field and operator the first value counts, an
unknown one-word operator matches nothing, a longer one is dropped, an indexed string equality that comes first matches
prefixes, and NaN fails every comparison but ``!=``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnknownField, UnsupportedOperator
from ..schema import FieldSchema, TableSchema

EQUALITY = ("=", "!=")
ORDER = (">", "<", ">=", "<=")
CONTAINS = "LIKE"
PREFIX = "PREFIX"


@dataclass(frozen=True)
class Predicate:
    field: str
    op: str
    value: Any


def operators_of(f: FieldSchema) -> tuple[str, ...]:
    if f.repeated:
        return ()
    return EQUALITY + (ORDER if f.is_number else ()) + ((CONTAINS, PREFIX) if f.type == "string" else (PREFIX,) if f.type == "bytes" else ())


def _literal(f: FieldSchema, value: Any) -> Column:
    if isinstance(f.spark, T.DecimalType):
        value = str(value)
    return F.lit(bytearray(value) if isinstance(value, bytes) else value).cast(f.spark)


def _compare(f: FieldSchema, op: str, value: Any) -> Column:
    col, lit = F.col(f"`{f.name}`"), _literal(f, value)
    if op == CONTAINS:
        return F.contains(col, lit)
    if op == PREFIX:
        return F.startswith(col, lit)
    return {"=": col == lit, "!=": col != lit, ">": col > lit, "<": col < lit, ">=": col >= lit, "<=": col <= lit}[op]


def condition(table: TableSchema, p: Predicate) -> Column:
    """The predicate as a column expression that Catalyst can push into the scan."""
    if p.field == table.primary_key:
        f = table.pk
    else:
        f = table.field(p.field)
    if f.repeated:
        raise UnknownField(f"{table.name}.{f.name} is repeated and takes no predicate")
    if p.op not in operators_of(f):
        raise UnsupportedOperator(f"{table.name}.{f.name} ({f.type}) has no operator {p.op!r}")
    return _compare(f, p.op, p.value)


def _compat(table: TableSchema, given: tuple[Predicate, ...]) -> list[Column]:
    first: dict[tuple[str, str], Any] = {}
    out = []
    for i, p in enumerate(given):
        value = first.setdefault((p.field, p.op), p.value)
        if len(p.op.split()) > 1:
            continue
        f = table.field(p.field)
        if p.op not in operators_of(f) or p.op == PREFIX:
            out.append(F.lit(False))
        elif i == 0 and p.op == "=" and f.type == "string" and table.indexes and table.indexes[0].name == f.name:
            out.append(_compare(f, PREFIX, value))
        else:
            c = _compare(f, p.op, value)
            out.append(c & ~F.isnan(f"`{f.name}`") if isinstance(f.spark, (T.DoubleType, T.FloatType)) and p.op != "!=" else c)
    return out


def conjunction(table: TableSchema, given: tuple[Predicate, ...], compat: bool = False) -> Column | None:
    parts = _compat(table, given) if compat else [condition(table, p) for p in given]
    return reduce(lambda a, b: a & b, parts) if parts else None
