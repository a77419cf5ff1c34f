"""Views for looking into a store: raw entries, sorted rows, one key, sizes."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotFound
from ..functions import codec, text
from ..schema import SchemaRegistry, TableSchema
from . import paging, ttl


def cursor_of(key: bytes) -> str:
    return base64.urlsafe_b64encode(key).rstrip(b"=").decode()


def key_of(cursor: str) -> bytes:
    """The key of a cursor; a ValueError for text that is no cursor."""
    return base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True)


def raw_view(tables: list[tuple[TableSchema, DataFrame]], kv: DataFrame) -> DataFrame:
    """(key, value) of the raw pairs and of the records (with their expiry) of typed tables, as one keyspace.

    A declared table's rows are encoded as they are read; their keys are expressions, so a page costs the tables it shows.
    """
    for table, records in tables:
        kv = kv.unionByName(codec.encode_records(records, table, ttl.EXPIRES if ttl.EXPIRES in records.columns else None))
    return kv


ROW_STRUCT = "struct<fields:array<struct<name:string,type:string,value:string>>,expires_at:long,expired:boolean>"


def _decoded_row(registry: SchemaRegistry, now: int):
    @F.pandas_udf(ROW_STRUCT)
    def apply(keys: pd.Series, values: pd.Series) -> pd.DataFrame:
        out = []
        for key, value in zip(keys, values, strict=True):
            table = registry.by_key(bytes(key)) if bytes(key[:1]) != b"\xff" else None
            expires, fields = codec.decode_fields(table, bytes(value)) if table else (0, [])
            out.append(([(n, kind, v.hex() if isinstance(v, bytes) else str(v)) for n, kind, v in fields], expires, 0 < expires < now))
        return pd.DataFrame(out, columns=["fields", "expires_at", "expired"])

    return apply


def entries(kv: DataFrame, registry: SchemaRegistry, prefix: bytes = b"", cursor: str = "", limit: int | str | None = None, decode: bool = False, now: int | None = None) -> tuple[DataFrame, str | None]:
    """A page of (key_hex, key_b64, key, size, preview, decoded) in byte order, and the cursor of the next one.

    decode: also `row`, the record's fields, expiry and whether it is past.
    """
    from ..sources.kv import in_prefix

    n = paging.clamp_limit(limit)
    df = kv.where(in_prefix(prefix)) if prefix else kv
    if cursor:
        df = df.where(F.col("key") > F.lit(bytearray(key_of(cursor))))
    window = df.orderBy("key").limit(n + 1)
    keys = [bytes(r["key"]) for r in window.select("key").collect()]
    shown = window.limit(n) if len(keys) > n else window
    view = shown.select(
        text.hex_dump(F.col("key")).alias("key_hex"), text.base64url(F.col("key")).alias("key_b64"), text.printable_column(F.col("key")).alias("key"), F.octet_length("value").cast("long").alias("size"),
        text.printable_column(F.substring("value", 1, text.PREVIEW_BYTES)).alias("preview"), codec.decode_key_column(registry, F.col("key")).alias("decoded"),
        *([_decoded_row(registry, ttl.now_ns() if now is None else now)(F.col("key"), F.col("value")).alias("row")] if decode else []),
    )
    return view, cursor_of(keys[n - 1]) if len(keys) > n else None


def sorted_view(records: DataFrame, table: TableSchema, offset: int = 0, limit: int | str | None = None, now: int | None = None) -> DataFrame:
    """A page of rows by primary key, expired ones with a flag."""
    df = ttl.flagged(records, ttl.now_ns() if now is None else now) if table.ttl_ns else records
    return paging.offset_page(df, table.primary_key, offset, paging.clamp_limit(limit))


def point_view(kv: DataFrame, registry: SchemaRegistry, key: bytes, now: int | None = None) -> dict:
    """One entry: hex and printable value with their truncation, the decoded key, and the record's fields."""
    row = kv.where(F.col("key") == F.lit(bytearray(key))).first()
    if row is None:
        raise NotFound(key.hex())
    value, decoded = bytes(row["value"]), codec.describe_key(registry, key)
    table = registry.by_name(decoded["table"]) if decoded["table"] else None
    out = {"key": key.hex(), "size": len(value), "hex": value[: text.HEX_BYTES].hex(), "printable": text.printable(value[: text.PRINT_BYTES]), "truncated": len(value) > text.HEX_BYTES, "decoded": decoded, "fields": [], "expires_at": 0, "expired": False}
    if decoded["kind"] == "index" and table:
        out["decoded"] = decoded | {"pk": codec.show_scalar(table.pk, value)}  # an entry's value is the key
    elif table:
        out["expires_at"], out["fields"] = codec.decode_fields(table, value)
        out["expired"] = 0 < out["expires_at"] < (ttl.now_ns() if now is None else now)
    return out


def group_sizes(df: DataFrame, by: str, payload: str) -> DataFrame:
    """(by, n, bytes) of a text or binary column."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(payload).cast("long")).alias("bytes"))


def folder_stats(spark, path: str) -> DataFrame:
    """(files, bytes) below a folder, from its listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
