"""The given tables declared as record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ttl
from ..operators.query import Query
from ..schema import SECOND, FieldSchema, TableSchema

CUSTOMER = TableSchema.declare("customer", [("c_custkey", "int64"), FieldSchema("c_name", "string", 2, index="unique"), ("c_nationkey", "int32"), ("c_acctbal", "double"), ("c_mktsegment", "string")], "c_custkey", table_id=1)
ORDERS = TableSchema.declare("orders", [("o_orderkey", "int64"), FieldSchema("o_custkey", "int64", 2, index="normal"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderpriority", "string")], "o_orderkey", table_id=2)
EVENTS = TableSchema.declare("events", [("event_id", "int64"), FieldSchema("user_id", "int64", 2, index="normal"), ("event_type", "string"), ("value", "double"), ("props", "string")], "event_id", table_id=3, ttl_ns=7 * 86400 * SECOND)
DOCUMENTS = TableSchema.declare("documents", [("doc_id", "int64"), FieldSchema("text", "string", 2, compress=True), ("lang", "string"), ("source", "string"), ("n_chars", "int64")], "doc_id", table_id=4)
NATION = TableSchema.declare("nation", [("n_nationkey", "int32"), ("n_name", "string"), ("n_regionkey", "int32")], "n_nationkey", table_id=5)
LINEITEM = TableSchema.declare("lineitem", [("l_orderkey", "int64"), ("l_partkey", "int64"), ("l_suppkey", "int64"), ("l_linenumber", "int32"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string")], "l_orderkey", table_id=6)

#: 2024-01-15 00:00:00 in nanoseconds: the clock of the queries over events.
CLOCK = 1705276800 * SECOND


def read(spark: SparkSession, sf_dir: str, table: TableSchema) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table.name}.parquet")


def query(spark: SparkSession, sf_dir: str, table: TableSchema, **more) -> Query:
    return Query(table, read(spark, sf_dir, table), **more)


def expiring_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the expiry that a record written at ts would have."""
    written = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return read(spark, sf_dir, EVENTS).withColumn(ttl.EXPIRES, (written + F.lit(EVENTS.ttl_ns)).cast("long"))
