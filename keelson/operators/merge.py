"""Versions of records: the newest operation on a key wins.

A log row is (_seq, _op, _expires_at, fields): op 0 puts, op 1 deletes. Merging is an aggregate with partial sums; where a
compacted base (one put for each key) is at hand, only the newer tail is aggregated and the base loses the tail's keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQ, OP = "_seq", "_op"
PUT, DELETE = 0, 1
#: A tail's keys are broadcast against the base if their measured bytes, and so many for each row, are at most this.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 32


def newest(log: DataFrame, pk: str) -> DataFrame:
    """The last operation on each key; of two with one sequence number, that with the larger hash.

    The key stays a grouping column, so predicates on it go below the aggregate, into the scan of the log.
    """
    rest = [c for c in log.columns if c != pk]
    order = F.struct(F.col(SEQ), F.xxhash64(*[f"`{c}`" for c in rest]))
    best = log.groupBy(pk).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("_r"))
    return best.select(*[F.col(f"`{c}`") if c == pk else F.col(f"_r.`{c}`").alias(c) for c in log.columns])


def puts(latest: DataFrame) -> DataFrame:
    return latest.where(F.col(OP) == PUT)


def merge(base: DataFrame | None, tail: DataFrame | None, pk: str, tail_bytes: int | None = None) -> DataFrame:
    """Records as they stand: the base's, but for keys that the tail touches, and the tail's puts.

    tail_bytes: what the tail's keys take at most, measured when they were written; unknown, nothing is broadcast.
    """
    if tail is None:
        return base
    last = newest(tail, pk)
    if base is None:
        return puts(last)
    keys = tail.select(F.col(pk)).distinct()
    small = tail_bytes is not None and tail_bytes <= BROADCAST_BYTES
    return base.join(F.broadcast(keys) if small else keys, pk, "left_anti").select(*base.columns).unionByName(puts(last))


def last_write(df: DataFrame, key: str, order: str | Column, value: str | Column) -> DataFrame:
    """(key, value of the row with the largest order)."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value if isinstance(value, str) else "value"))
