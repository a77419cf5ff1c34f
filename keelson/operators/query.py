"""The fluent query over a record table: an immutable builder that ends in a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import UnknownField
from ..schema import TableSchema
from . import paging, ttl
from .predicates import PREFIX, Predicate, conjunction


@dataclass(frozen=True)
class Query:
    """``Query(table, df).where("age", ">", 3).limit(10).exec()``; every call returns a new query.

    `now` is read once when the plan is made, or given; rows of tables with a time to live are seen while they live.
    Rows come in key order where a limit, a cursor or `first` needs one. `compat`: see `predicates`.
    """

    table: TableSchema
    source: DataFrame
    predicates: tuple[Predicate, ...] = ()
    n: int = 0
    last: Any = None
    now: int | None = None
    compat: bool = False
    columns: tuple[str, ...] = ()

    def __getattr__(self, name: str):
        if name.startswith("where_"):
            field = name[len("where_") :]
            if field in (f.name for f in self.table.fields):
                return partial(self.where, field)
        raise AttributeError(name)

    def where(self, field: str, op: str, value: Any) -> Query:
        if self.compat and field == self.table.primary_key:
            raise UnknownField(f"the primary key {field} takes no predicate in compat mode")
        out = replace(self, predicates=(*self.predicates, Predicate(field, op, value)))
        conjunction(self.table, out.predicates, self.compat)  # raises now, not at execution
        return out

    def where_prefix(self, field: str, value: str | bytes) -> Query:
        return self.where(field, PREFIX, value)

    def limit(self, n: int) -> Query:
        return replace(self, n=n)

    def after(self, key: Any) -> Query:
        """Resume strictly after a primary key."""
        return replace(self, last=key)

    def at(self, now: int) -> Query:
        return replace(self, now=now)

    def select(self, *columns: str) -> Query:
        return replace(self, columns=columns)

    def _matching(self) -> DataFrame:
        df, now = self.source, self.now
        if self.table.ttl_ns and ttl.EXPIRES in df.columns:
            df = ttl.live(df, ttl.now_ns() if now is None else now)
        if (c := conjunction(self.table, self.predicates, self.compat)) is not None:
            df = df.where(c)
        if self.last is not None:
            df = df.where(F.col(self.table.primary_key) > F.lit(self.last))
        return df

    def exec(self) -> DataFrame:
        df = self._matching()
        if self.n > 0 or self.last is not None:
            df = paging.page(df, self.table.primary_key, self.n)
        return df.select(*(self.columns or [f.name for f in self.table.fields if f.name in df.columns]))

    def first(self) -> Row | None:
        rows = replace(self, n=1).exec().take(1)
        return rows[0] if rows else None

    def count_frame(self) -> DataFrame:
        """One row n: the matching rows, within the limit and past the cursor. Without a limit nothing is sorted."""
        df = self._matching()
        return (paging.page(df, self.table.primary_key, self.n) if self.n > 0 else df).agg(F.count(F.lit(1)).alias("n"))

    def count(self) -> int:
        return self.count_frame().first()["n"]

    def pages(self, size: int):
        """Lists of rows, page by page, each found from the last key of the one before."""
        query, pk = replace(self, n=size), self.table.primary_key
        while rows := query.exec().collect():
            yield rows
            if len(rows) < size:
                return
            query = query.after(rows[-1][pk])


def next_cursor(rows: list[Row], table: TableSchema):
    """The key to go on after, or None at the end."""
    return rows[-1][table.primary_key] if rows else None
