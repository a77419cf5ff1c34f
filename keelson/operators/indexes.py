"""Secondary indexes as derived tables.

An index is never stored beside the records and cannot go stale: its entries are a projection of them. A store that is
read by an indexed field more than by its key keeps a copy sorted by that field (`write_index`), where Parquet's
statistics and bloom filters find a value's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TableSchema


def index_entries(df: DataFrame, pk: str, field: str) -> DataFrame:
    """(index_field, index_value, pk) in the form that all indexes share: the value as text."""
    return df.select(F.lit(field).alias("index_field"), F.col(field).cast("string").alias("index_value"), F.col(pk).alias("pk"))


def fetch_by_index(rows: DataFrame, entries: DataFrame, pk: str, value) -> DataFrame:
    """Rows whose key an entry with the value names; entries without a row find nothing."""
    keys = entries.where(F.col("index_value") == F.lit(str(value))).select(F.col("pk").alias(pk))
    return rows.join(keys, pk, "left_semi")


def duplicates(df: DataFrame, field: str) -> DataFrame:
    """(value, n) of the values that break a unique index."""
    return df.groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(df: DataFrame, table: TableSchema) -> DataFrame:
    """(field, value, n) over the primary key and all unique indexes."""
    out = None
    for f in [table.pk, *[f for f in table.indexes if f.index == "unique"]]:
        part = duplicates(df, f.name).select(F.lit(f.name).alias("field"), F.col("value").cast("string"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def write_index(df: DataFrame, pk: str, field: str, path: str, partitions: int | None = None) -> None:
    """A copy sorted by (field, pk) with a bloom filter on the field."""
    by = [field, pk]
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.option("parquet.bloom.filter.enabled#" + field, "true").mode("overwrite").parquet(path)
