"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is an aggregate with partial sums and a plain equi-join, so a hub's edges never meet in one task, and
every result is a written table, so a lost executor costs its tasks alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:  # every larger neighbour of u goes to u's smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # every smaller neighbour, and u itself, goes to u's smallest neighbour
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    low = materialize(low, "low")  # read again, both sides of the join are dealt anew, and a hub's rows can be split
    moved = both.join(low, both["a"] == low["u"])
    if large:
        moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Returns (node, root) for every node of an edge; the root is the smallest node reachable.

    Null ends and loops are ignored; an empty edge table gives an empty result.
    """
    now = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        now = materialize(_star(_star(now, True), False), "edges")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
    raise RuntimeError(f"no components after {rounds} rounds")
