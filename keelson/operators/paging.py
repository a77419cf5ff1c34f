"""Order, limits and cursors. Orders end in a unique key, so a page is the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCAN_GUARD = 10_000
PAGE_LIMIT, PAGE_MAX = 50, 500


def clamp_limit(text: str | int | None, default: int = PAGE_LIMIT, low: int = 1, high: int = PAGE_MAX) -> int:
    """A page size from a request: the default where it is no number, else within the bounds."""
    try:
        return min(high, max(low, int(text)))
    except (TypeError, ValueError):
        return default


def page(df: DataFrame, pk: str, n: int) -> DataFrame:
    """The first n rows by key; n <= 0 means all."""
    ordered = df.orderBy(pk)
    return ordered.limit(n) if n > 0 else ordered


def after(df: DataFrame, pk: str, last, n: int = 0) -> DataFrame:
    """Keyset paging: the rows strictly past the last key seen; the bound reaches the scan."""
    return page(df.where(F.col(pk) > F.lit(last)), pk, n)


def before(df: DataFrame, pk: str, bound) -> DataFrame:
    """The last row below the bound."""
    return df.where(F.col(pk) < F.lit(bound)).orderBy(F.desc(pk)).limit(1)


def offset_page(df: DataFrame, pk: str, offset: int, n: int) -> DataFrame:
    return df.orderBy(pk).offset(offset).limit(n)


def scan_guard(df: DataFrame, guard: int = SCAN_GUARD) -> DataFrame:
    """total (at most the guard) and truncated, from a scan that stops one row past the guard."""
    n = F.count(F.lit(1))
    return df.select(F.lit(1)).limit(guard + 1).agg(F.least(n, F.lit(guard)).alias("total"), (n > guard).alias("truncated"))


def index_page(df: DataFrame, field: str, pk: str, n: int = 0) -> DataFrame:
    """Rows in the order of an index: by the field's value, then by key; n <= 0 means all."""
    ordered = df.orderBy(field, pk)
    return ordered.limit(n) if n > 0 else ordered


def physical_positions(df: DataFrame, pk: str) -> DataFrame:
    """(pk, position) in physical order, from 1, without one task that sorts all keys.

    Keys are dealt by their first two bytes: a row's position is its rank among the keys of its bucket and the count of
    all buckets before, a broadcast of at most 65,536 rows.
    """
    low = F.col(pk).cast("long")
    keyed = df.select(pk, (low.bitwiseAND(F.lit(255)) * 256 + F.shiftrightunsigned(low, 8).bitwiseAND(F.lit(255))).alias("_b"))
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(*physical_order(F.col(pk))))
    return keyed.select(pk, "_b", rank.cast("long").alias("_r")).join(F.broadcast(before), "_b").select(pk, (F.col("_r") + F.col("_before")).alias("position"))


def physical_order(pk: Column, width: int = 8) -> list[Column]:
    """Sort keys that put integers in the byte order of their little-endian form."""
    wide = pk.cast("long")
    return [F.shiftrightunsigned(wide, 8 * k).bitwiseAND(F.lit(255)) for k in range(width)]
