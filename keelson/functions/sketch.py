"""Count-min sketches: one that ages, for the driver, and Spark's aggregate for tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH, WIDTH, AGE_AFTER = 4, 2048, 1_000_000


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


class CountMinSketch:
    """Never estimates too little between two agings; an aging halves all counts."""

    def __init__(self, depth: int = DEPTH, width: int = WIDTH, age_after: int = AGE_AFTER):
        self.counts, self.age_after, self.added = np.zeros((depth, width), dtype=np.uint32), age_after, 0

    def _cells(self, key: bytes):
        a, b = fnv1a64(key), fnv1a64(key + b"\xff") | 1
        depth, width = self.counts.shape
        return np.arange(depth), np.array([(a + k * b) % width for k in range(depth)])

    def add(self, key: bytes) -> None:
        cells = self._cells(key)
        self.counts[cells] = np.minimum(self.counts[cells].astype(np.uint64) + 1, 0xFFFFFFFF).astype(np.uint32)
        self.added += 1
        if self.added >= self.age_after:
            self.counts >>= 1
            self.added = 0

    def estimate(self, key: bytes) -> int:
        return int(self.counts[self._cells(key)].min())


def cell_counts(df: DataFrame, column: str) -> DataFrame:
    """(depth, cell, n): the counts of a count-min sketch of DEPTH rows of WIDTH cells; cells are 16-bit parts of an MD5.

    At most DEPTH * WIDTH rows leave the aggregate, however many values there are; sketches add up by cell.
    """
    digest = F.md5(F.col(column).cast("string").cast("binary"))
    cells = [F.struct(F.lit(k).alias("depth"), F.pmod(F.conv(F.substring(digest, 1 + 4 * k, 4), 16, 10).cast("int"), F.lit(WIDTH)).alias("cell")) for k in range(DEPTH)]
    given = df.where(F.col(column).isNotNull()).select(F.explode(F.array(*cells)).alias("c"))
    return given.groupBy("c.depth", "c.cell").agg(F.count(F.lit(1)).alias("n"))


def frequency_sketch(column: str | Column, seed: int = 42) -> Column:
    """Spark's sketch with the same depth and width, as an aggregate that merges partial sketches."""
    return F.count_min_sketch(column, F.lit(2 / WIDTH), F.lit(1 - 0.5**DEPTH), F.lit(seed))
