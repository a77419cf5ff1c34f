"""The registered queries over the given tables, each with the DuckDB text that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, sketch, text
from ..metrics import bucket_counts
from ..operators import indexes, inspect, merge, paging, ttl
from ..operators.query import Query
from ..schema import TableSchema
from .tables import CLOCK, CUSTOMER, DOCUMENTS, EVENTS, LINEITEM, NATION, ORDERS, expiring_events, query, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
_EVENTS = "event_id, user_id, event_type, value, props"
_EXPIRES = "CAST(epoch_us(ts) AS BIGINT) * 1000 + 604800000000000"


def _query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered, ordered page of customers."""
    q = query(spark, sf_dir, CUSTOMER).where("c_mktsegment", "=", "BUILDING").where("c_acctbal", ">=", 0.0)
    return q.where("c_name", "LIKE", "0000").limit(20).exec()


@_query(f"SELECT {_CUSTOMER} FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 AND contains(c_name, '0000') ORDER BY c_custkey LIMIT 20")
def flagship_page(spark, sf_dir):
    return flagship(spark, sf_dir)


# sources and predicates


@_query(f"SELECT {_CUSTOMER} FROM customer WHERE c_custkey = 42")
def point_get(spark, sf_dir):
    return query(spark, sf_dir, CUSTOMER).where("c_custkey", "=", 42).exec()


@_query(f"SELECT {_CUSTOMER} FROM customer")
def full_scan(spark, sf_dir):
    return query(spark, sf_dir, CUSTOMER).exec()


@_query(f"SELECT {_CUSTOMER} FROM customer WHERE c_mktsegment = 'BUILDING'")
def where_eq_string(spark, sf_dir):
    return query(spark, sf_dir, CUSTOMER).where("c_mktsegment", "=", "BUILDING").exec()


@_query(f"SELECT {_CUSTOMER} FROM customer WHERE contains(c_name, '00001')")
def where_like_contains(spark, sf_dir):
    return query(spark, sf_dir, CUSTOMER).where("c_name", "LIKE", "00001").exec()


@_query(f"SELECT {_CUSTOMER} FROM customer WHERE c_nationkey <> 7")
def where_ne_int(spark, sf_dir):
    return query(spark, sf_dir, CUSTOMER).where("c_nationkey", "!=", 7).exec()


@_query(f"SELECT {_ORDERS} FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 200000")
def where_range_double(spark, sf_dir):
    return query(spark, sf_dir, ORDERS).where("o_totalprice", ">=", 100000.0).where("o_totalprice", "<=", 200000.0).exec()


@_query(f"SELECT {_ORDERS} FROM orders WHERE o_totalprice > 300000")
def where_gt(spark, sf_dir):
    return query(spark, sf_dir, ORDERS).where("o_totalprice", ">", 300000.0).exec()


@_query(f"SELECT {_ORDERS} FROM orders WHERE o_totalprice < 50000")
def where_lt(spark, sf_dir):
    return query(spark, sf_dir, ORDERS).where("o_totalprice", "<", 50000.0).exec()


@_query(f"SELECT {_CUSTOMER} FROM customer WHERE c_nationkey <> 7 AND c_nationkey <> 3")
def where_duplicate_op(spark, sf_dir):
    return query(spark, sf_dir, CUSTOMER).where("c_nationkey", "!=", 7).where("c_nationkey", "!=", 3).exec()


@_query(f"SELECT {_CUSTOMER} FROM customer WHERE c_nationkey <> 7")
def compat_duplicate_op(spark, sf_dir):
    return query(spark, sf_dir, CUSTOMER, compat=True).where("c_nationkey", "!=", 7).where("c_nationkey", "!=", 3).exec()


@_query(f"SELECT {_CUSTOMER} FROM customer WHERE starts_with(c_name, 'Customer#00000004') AND c_nationkey <> 3")
def compat_index_prefix(spark, sf_dir):
    return query(spark, sf_dir, CUSTOMER, compat=True).where("c_name", "=", "Customer#00000004").where("c_nationkey", "!=", 3).exec()


@_query(f"SELECT {_CUSTOMER} FROM customer WHERE false")
def compat_unknown_op(spark, sf_dir):
    return query(spark, sf_dir, CUSTOMER, compat=True).where("c_mktsegment", "~", "BUILDING").exec()


@_query("SELECT event_id, value > 10 AS big FROM events WHERE (value > 10) = true")
def where_eq_bool(spark, sf_dir):
    from ..schema import TableSchema

    table = TableSchema.declare("flags", [("event_id", "int64"), ("big", "bool")], "event_id")
    return Query(table, read(spark, sf_dir, EVENTS).select("event_id", (F.col("value") > 10).alias("big"))).where("big", "=", True).exec()


@_query("SELECT n_nationkey, n_name FROM nation WHERE encode(n_name) <> encode((SELECT min(n_name) FROM nation))")
def where_ne_bytes(spark, sf_dir):
    from ..schema import TableSchema

    table = TableSchema.declare("names", [("n_nationkey", "int32"), ("raw", "bytes"), ("n_name", "string")], "n_nationkey")
    rows = read(spark, sf_dir, NATION)
    least = rows.agg(F.min("n_name")).first()[0]
    found = Query(table, rows.select("n_nationkey", "n_name", F.to_binary("n_name", F.lit("utf-8")).alias("raw"))).where("raw", "!=", least.encode())
    return found.select("n_nationkey", "n_name").exec()


@_query("SELECT event_id, event_type, value FROM events WHERE value > 10 AND event_type = 'click'")
def projected_filter(spark, sf_dir):
    return query(spark, sf_dir, EVENTS).where("value", ">", 10.0).where("event_type", "=", "click").select("event_id", "event_type", "value").exec()


# indexes


@_query(f"SELECT {_ORDERS} FROM orders WHERE o_custkey = 370")
def index_eq(spark, sf_dir):
    return query(spark, sf_dir, ORDERS).where("o_custkey", "=", 370).exec()


@_query(f"SELECT {_CUSTOMER} FROM customer WHERE starts_with(c_name, 'Customer#00000004')")
def index_prefix(spark, sf_dir):
    return query(spark, sf_dir, CUSTOMER).where_prefix("c_name", "Customer#00000004").exec()


@_query(f"SELECT {_ORDERS} FROM orders WHERE o_custkey = 370 AND o_orderstatus = 'F'")
def index_residual(spark, sf_dir):
    return query(spark, sf_dir, ORDERS).where("o_custkey", "=", 370).where("o_orderstatus", "=", "F").exec()


@_query("SELECT 'user_id' AS index_field, CAST(user_id AS VARCHAR) AS index_value, event_id AS pk FROM events")
def index_entries(spark, sf_dir):
    return indexes.index_entries(read(spark, sf_dir, EVENTS), "event_id", "user_id")


@_query(f"SELECT {_EVENTS} FROM events WHERE event_id IN (SELECT event_id FROM events WHERE user_id = 17)")
def index_semi_join(spark, sf_dir):
    rows = query(spark, sf_dir, EVENTS).exec()
    return indexes.fetch_by_index(rows, indexes.index_entries(rows, "event_id", "user_id"), "event_id", 17)


@_query("SELECT CAST(c_nationkey AS VARCHAR) AS value, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
def strict_unique_violations(spark, sf_dir):
    return indexes.duplicates(read(spark, sf_dir, CUSTOMER), "c_nationkey").select(F.col("value").cast("string").alias("value"), "n")


# order, limit, cursor


@_query(f"SELECT {_CUSTOMER} FROM customer ORDER BY c_custkey LIMIT 20")
def limit_page(spark, sf_dir):
    return query(spark, sf_dir, CUSTOMER).limit(20).exec()


@_query(f"SELECT {_ORDERS} FROM orders WHERE o_orderkey > 5000 AND o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 20")
def keyset_after(spark, sf_dir):
    return query(spark, sf_dir, ORDERS).where("o_orderstatus", "=", "O").after(5000).limit(20).exec()


@_query(f"SELECT {_ORDERS} FROM orders WHERE o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 1")
def seek_before(spark, sf_dir):
    return paging.before(query(spark, sf_dir, ORDERS).exec(), "o_orderkey", 5000)


@_query(f"SELECT {_CUSTOMER} FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 1")
def first_match(spark, sf_dir):
    row = query(spark, sf_dir, CUSTOMER).where("c_mktsegment", "=", "MACHINERY").first()
    return spark.createDataFrame([row] if row else [], CUSTOMER.spark)


@_query("SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def count_where(spark, sf_dir):
    return query(spark, sf_dir, EVENTS).where("event_type", "=", "click").count_frame()


@_query("SELECT count(*) AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25)")
def count_limited(spark, sf_dir):
    return query(spark, sf_dir, ORDERS).where("o_orderstatus", "=", "F").limit(25).count_frame()


@_query(f"SELECT {_CUSTOMER} FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def offset_page(spark, sf_dir):
    return paging.offset_page(query(spark, sf_dir, CUSTOMER).exec(), "c_custkey", 100, 50)


@_query("SELECT least(count(*), 10000) AS total, count(*) > 10000 AS truncated FROM orders")
def scan_guard(spark, sf_dir):
    return paging.scan_guard(read(spark, sf_dir, ORDERS))


@_query("SELECT c_custkey, row_number() OVER (ORDER BY " + ", ".join(f"(c_custkey >> {8 * k}) & 255" for k in range(8)) + ") AS position FROM customer")
def physical_order(spark, sf_dir):
    return paging.physical_positions(read(spark, sf_dir, CUSTOMER), "c_custkey")


@_query(f"SELECT {_ORDERS} FROM orders ORDER BY o_custkey, o_orderkey LIMIT 100")
def index_order(spark, sf_dir):
    return paging.index_page(query(spark, sf_dir, ORDERS).exec(), "o_custkey", "o_orderkey", 100)


# time to live


@_query(f"SELECT {_EVENTS} FROM events WHERE {_EXPIRES} = 0 OR {_EXPIRES} >= {CLOCK}")
def ttl_live(spark, sf_dir):
    return Query(EVENTS, expiring_events(spark, sf_dir), now=CLOCK).exec()


@_query(f"SELECT count(*) AS purged FROM events WHERE {_EXPIRES} > 0 AND {_EXPIRES} < {CLOCK}")
def ttl_purge_count(spark, sf_dir):
    return ttl.expired(expiring_events(spark, sf_dir), CLOCK).agg(F.count(F.lit(1)).alias("purged"))


@_query(f"SELECT event_id, {_EXPIRES} AS _expires_at, {_EXPIRES} < {CLOCK} AS expired FROM events")
def ttl_flagged(spark, sf_dir):
    return ttl.flagged(expiring_events(spark, sf_dir), CLOCK).select("event_id", ttl.EXPIRES, "expired")


@_query(f"SELECT event_id, user_id, {CLOCK + EVENTS.ttl_ns} AS _expires_at FROM events")
def ttl_stamp(spark, sf_dir):
    return ttl.stamp(read(spark, sf_dir, EVENTS).select("event_id", "user_id"), EVENTS.ttl_ns, CLOCK)


# versions


@_query("SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id")
def last_write_wins(spark, sf_dir):
    return merge.last_write(read(spark, sf_dir, EVENTS), "user_id", "ts", "event_id")


@_query(
    """
    WITH log AS (
      SELECT o_orderkey, o_totalprice, 0 AS seq, 0 AS op FROM orders
      UNION ALL SELECT o_orderkey, o_totalprice + 1, 1, 0 FROM orders WHERE o_orderkey % 5 = 0
      UNION ALL SELECT o_orderkey, NULL, 2, 1 FROM orders WHERE o_orderkey % 10 = 0),
    last AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) AS r FROM log)
    SELECT o_orderkey, o_totalprice FROM last WHERE r = 1 AND op = 0"""
)
def upsert_delete_merge(spark, sf_dir):
    base = read(spark, sf_dir, ORDERS).select("o_orderkey", "o_totalprice")
    log = lambda df, seq, op: df.withColumn(merge.SEQ, F.lit(seq).cast("long")).withColumn(merge.OP, F.lit(op).cast("byte"))
    updates = log(base.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), 1, merge.PUT)
    deletes = log(base.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.lit(None).cast("double")), 2, merge.DELETE)
    return merge.merge(log(base, 0, merge.PUT), updates.unionByName(deletes), "o_orderkey").select("o_orderkey", "o_totalprice")


# inspection


@_query("SELECT doc_id, octet_length(encode(text)) AS size, substring(text, 1, 64) AS preview FROM documents")
def entry_preview(spark, sf_dir):
    return read(spark, sf_dir, DOCUMENTS).select("doc_id", *text.entry_preview(F.col("text")))


@_query("SELECT n_nationkey, lower(hex(encode(n_name))) AS hex FROM nation")
def hex_dump(spark, sf_dir):
    return read(spark, sf_dir, NATION).select("n_nationkey", text.hex_dump(F.to_binary("n_name", F.lit("utf-8"))).alias("hex"))


@_query("SELECT n_nationkey, replace(replace(rtrim(base64(encode(n_name)), '='), '+', '-'), '/', '_') AS cursor FROM nation")
def base64url_keys(spark, sf_dir):
    return read(spark, sf_dir, NATION).select("n_nationkey", text.base64url(F.to_binary("n_name", F.lit("utf-8"))).alias("cursor"))


@_query("SELECT doc_id, octet_length(encode(repeat(text, 200))) > 262144 AS truncated FROM documents")
def truncation_flag(spark, sf_dir):
    return read(spark, sf_dir, DOCUMENTS).select("doc_id", text.truncated(F.repeat("text", F.lit(200))).alias("truncated"))


@_query("SELECT doc_id, 8 + 12 + 4 + 4 + 8 + octet_length(encode(text)) + octet_length(encode(lang)) + octet_length(encode(source)) AS size FROM documents")
def size_estimate(spark, sf_dir):
    return read(spark, sf_dir, DOCUMENTS).select("doc_id", codec.size_column(DOCUMENTS).alias("size"))


@_query("SELECT event_type, count(*) AS n, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes FROM events GROUP BY event_type")
def table_stats(spark, sf_dir):
    return inspect.group_sizes(read(spark, sf_dir, EVENTS), "event_type", "props")


@_query("SELECT CAST(greatest(0, least(11, ceil(log2(greatest(value, 1.0))))) AS INTEGER) AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def exp_buckets(spark, sf_dir):
    return bucket_counts(read(spark, sf_dir, EVENTS), "value")


_DESCRIBED = ", ".join(f"('{f.name}', '{f.type}', {f.name == t.primary_key}, '{f.index}', {t.compressed(f)})" for t in (DOCUMENTS,) for f in t.fields)


@_query(f"SELECT * FROM (VALUES {_DESCRIBED}) AS t(field, type, pk, index, compress)")
def describe_schema(spark, sf_dir):
    from ..schema import SchemaRegistry

    return SchemaRegistry([DOCUMENTS]).describe(spark).select("field", "type", "pk", "index", "compress")


# codecs

_LE = lambda c, n: " || ".join(f"printf('%02X', ({c} >> {8 * k}) & 255)" for k in range(n))


@_query(f"SELECT c_custkey, '01' || {_LE('c_custkey', 8)} AS key FROM customer")
def encode_key(spark, sf_dir):
    return read(spark, sf_dir, CUSTOMER).select("c_custkey", F.hex(codec.encode_key_column(CUSTOMER)).alias("key"))


@_query(f"SELECT o_orderkey, 'FF0202' || {_LE('o_custkey', 8)} || {_LE('o_orderkey', 8)} AS key FROM orders")
def encode_index_key(spark, sf_dir):
    return read(spark, sf_dir, ORDERS).select("o_orderkey", F.hex(codec.encode_index_key_column(ORDERS, "o_custkey")).alias("key"))


@_query("SELECT c_custkey, 'data' AS kind, 'customer' AS \"table\", CAST(c_custkey AS VARCHAR) AS pk FROM customer")
def decode_key(spark, sf_dir):
    from ..schema import SchemaRegistry

    keyed = read(spark, sf_dir, CUSTOMER).select("c_custkey", codec.decode_key_column(SchemaRegistry([CUSTOMER]), codec.encode_key_column(CUSTOMER)).alias("k"))
    return keyed.select("c_custkey", "k.kind", "k.table", "k.pk")


_REF = TableSchema.declare("order_ref", [("o_orderkey", "int64"), ("o_custkey", "int64"), ("o_orderstatus", "string"), ("o_orderpriority", "string")], "o_orderkey", table_id=7)
_TEXT = lambda c: f"{_LE(f'octet_length(encode({c}))', 4)} || hex(encode({c}))"


@_query(f"SELECT o_orderkey, {_LE('o_orderkey', 8)} || {_LE('o_custkey', 8)} || {_TEXT('o_orderstatus')} || {_TEXT('o_orderpriority')} AS value FROM orders")
def encode_value(spark, sf_dir):
    records = codec.encode_records(spark.read.parquet(f"{sf_dir}/orders.parquet"), _REF)
    number = F.conv(F.concat(*[F.hex(F.substring("key", 9 - k, 1)) for k in range(8)]), 16, 10).cast("long")  # the key's bytes, behind the table's id
    return records.select(number.alias("o_orderkey"), F.hex("value").alias("value"))


@_query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def decode_bytes(spark, sf_dir):
    """Records laid out by expressions, not by the codec that reads them."""
    size = lambda c: codec.little_endian(F.octet_length(c), 4)
    data = F.concat(codec.little_endian(F.col("o_orderkey"), 8), codec.little_endian(F.col("o_custkey"), 8), *[x for c in ("o_orderstatus", "o_orderpriority") for x in (size(c), F.to_binary(c, F.lit("utf-8")))])
    return codec.decode_records(spark.read.parquet(f"{sf_dir}/orders.parquet").select(data.alias("value")), _REF).drop("_expires_at")


@_query("SELECT o_orderkey, 'index' AS kind, 'orders' AS \"table\", 'o_custkey' AS field, CAST(o_custkey AS VARCHAR) AS value, CAST(o_orderkey AS VARCHAR) AS pk FROM orders")
def decode_index_key(spark, sf_dir):
    from ..schema import SchemaRegistry

    keyed = read(spark, sf_dir, ORDERS).select("o_orderkey", codec.decode_key_column(SchemaRegistry([ORDERS]), codec.encode_index_key_column(ORDERS, "o_custkey")).alias("k"))
    return keyed.select("o_orderkey", "k.kind", "k.table", "k.field", "k.value", "k.pk")


@_query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def codec_roundtrip(spark, sf_dir):
    return codec.decode_records(codec.encode_records(read(spark, sf_dir, DOCUMENTS), DOCUMENTS), DOCUMENTS).drop("_expires_at")


@_query(f"SELECT event_id, user_id, event_type, value, props, {_EXPIRES} AS _expires_at FROM events")
def decode_value(spark, sf_dir):
    return codec.decode_records(codec.encode_records(expiring_events(spark, sf_dir), EVENTS, ttl.EXPIRES), EVENTS)


@_query("SELECT doc_id, text FROM documents")
def zstd_roundtrip(spark, sf_dir):
    packed = read(spark, sf_dir, DOCUMENTS).select("doc_id", codec.compress_column(F.to_binary("text", F.lit("utf-8"))).alias("z"))
    return packed.select("doc_id", F.decode(codec.decompress_column(F.col("z")), "utf-8").alias("text"))


@_query("SELECT n_nationkey, n_name AS printed FROM nation")
def printable_names(spark, sf_dir):
    return read(spark, sf_dir, NATION).select("n_nationkey", text.printable_column(F.to_binary("n_name", F.lit("utf-8"))).alias("printed"))


@_query("SELECT depth, cell, count(*) AS n FROM (SELECT k AS depth, CAST(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), CAST(1 + 4 * k AS BIGINT), 4) AS BIGINT) % 2048 AS INTEGER) AS cell FROM events, (SELECT CAST(unnest(range(4)) AS INTEGER) AS k) WHERE user_id IS NOT NULL) GROUP BY depth, cell")
def cms_frequency(spark, sf_dir):
    return sketch.cell_counts(read(spark, sf_dir, EVENTS), "user_id")


# stores: the tables written, changed and read again


@_query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey % 5 <> 0")
def store_crud(spark, sf_dir):
    from ..sources.scratch import temporary_store

    rows = read(spark, sf_dir, NATION)
    table = temporary_store(spark).table(NATION)
    table.create(rows)
    table.update(rows.where("n_nationkey % 3 = 0").withColumn("n_name", F.lower("n_name")))
    table.delete(rows.where("n_nationkey % 5 = 0"))
    return table.read()


@_query(f"SELECT {_ORDERS} FROM orders WHERE o_custkey = 370")
def store_compacted_scan(spark, sf_dir):
    from ..sources.scratch import temporary_store

    table = temporary_store(spark).table(ORDERS)
    table.create(read(spark, sf_dir, ORDERS))
    table.compact()
    return table.query().where("o_custkey", "=", 370).exec()


@_query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05 AND l_discount <= 0.07 GROUP BY l_returnflag")
def lineitem_filter_count(spark, sf_dir):
    q = query(spark, sf_dir, LINEITEM).where("l_quantity", "<", 24.0).where("l_discount", ">=", 0.05).where("l_discount", "<=", 0.07)
    return q.select("l_returnflag").exec().groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
