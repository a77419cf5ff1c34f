"""An in-memory table with strict writes, for tests of code that uses a store."""

from __future__ import annotations

import copy
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import DuplicateKey, NotFound
from ..operators.query import Query
from ..schema import TableSchema


class MemoryTable:
    """Records by primary key; what goes in and comes out is copied. Nothing expires."""

    def __init__(self, schema: TableSchema):
        self.schema, self._rows = schema, {}

    def create(self, record: dict) -> None:
        key = record[self.schema.primary_key]
        if key in self._rows:
            raise DuplicateKey(f"{self.schema.name}: {key!r}")
        self._rows[key] = copy.deepcopy(record)

    def update(self, record: dict) -> None:
        key = record[self.schema.primary_key]
        if key not in self._rows:
            raise NotFound(f"{self.schema.name}: {key!r}")
        self._rows[key] = copy.deepcopy(record)

    def delete(self, key: Any) -> None:
        self._rows.pop(key, None)

    def get(self, key: Any) -> dict | None:
        return copy.deepcopy(self._rows.get(key))

    def purge_expired(self) -> int:
        return 0

    def __len__(self) -> int:
        return len(self._rows)

    def read(self, spark: SparkSession) -> DataFrame:
        names = [f.name for f in self.schema.fields]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in self._rows.values()], self.schema.spark)

    def query(self, spark: SparkSession) -> Query:
        return Query(self.schema, self.read(spark))
