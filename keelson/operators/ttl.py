"""Record expiry: a hidden column of absolute nanoseconds, 0 for never; one clock reading for each query."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPIRES = "_expires_at"


def now_ns() -> int:
    return time.time_ns()


def stamp(df: DataFrame, ttl_ns: int, now: int | None = None, column: str = EXPIRES) -> DataFrame:
    """Sets the expiry that a create or an update gives: now + ttl, or never for a table without one."""
    return df.withColumn(column, F.lit((now_ns() if now is None else now) + ttl_ns if ttl_ns else 0).cast("long"))


def is_expired(expires: Column, now: Column | int) -> Column:
    """Past its time: an expiry is set and lies before now (not at now)."""
    now = F.lit(now).cast("long") if isinstance(now, int) else now
    return (expires > 0) & (expires < now)


def live(df: DataFrame, now: int, column: str = EXPIRES) -> DataFrame:
    return df.where((F.col(column) == 0) | (F.col(column) >= F.lit(now).cast("long")))


def expired(df: DataFrame, now: int, column: str = EXPIRES) -> DataFrame:
    return df.where(is_expired(F.col(column), now))


def flagged(df: DataFrame, now: int, column: str = EXPIRES, flag: str = "expired") -> DataFrame:
    """All rows with a flag, as an inspection view shows them."""
    return df.withColumn(flag, is_expired(F.col(column), now))
