"""The byte format of keys and records, for exchange with stores that keep them as raw bytes.

Keys: uvarint(table id) and the primary key's bytes; index keys: FF, uvarint(table id), one byte field number, the value's
bytes, the primary key's bytes. Records: the fields in order of declaration; fixed-width ones little-endian, others
u32 length and data, compressed ones u32 stored length, u32 original length and data (equal lengths: stored raw). Tables
with a time to live put an int64 expiry before.

Encoders of keys are Spark expressions. Decoders and records go through Arrow-batched functions.
"""

from __future__ import annotations

import struct
import threading
from collections.abc import Callable
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MalformedKey, MalformedValue
from ..schema import FieldSchema, SchemaRegistry, TableSchema, uvarint

_FORMATS = {"double": "<d", "float": "<f", "bool": "<?", **dict.fromkeys(("int64", "sint64", "sfixed64"), "<q"), **dict.fromkeys(("uint64", "fixed64"), "<Q"), **dict.fromkeys(("int32", "sint32", "sfixed32", "enum"), "<i"), **dict.fromkeys(("uint32", "fixed32"), "<I")}
INDEX_MARK = 0xFF
#: Bytes that the size bound counts before a compressed field's data: one length more than is written.
COMPRESSED_HEAD = 12
#: A thread's compressor and decompressor, which take longer to make than to use on a short text.
_zstd = threading.local()


def zstd_compress(data: bytes) -> bytes:
    import zstandard

    if not hasattr(_zstd, "pack"):
        _zstd.pack = zstandard.ZstdCompressor(level=1)
    return _zstd.pack.compress(data)


def zstd_decompress(data: bytes, size: int) -> bytes:
    import zstandard

    if not hasattr(_zstd, "unpack"):
        _zstd.unpack = zstandard.ZstdDecompressor()
    return _zstd.unpack.decompress(data, max_output_size=size)


# plain functions


def read_uvarint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number and where it ends."""
    n = shift = 0
    while at < len(data) and shift < 64:
        b = data[at]
        n |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return n, at
    raise MalformedKey("a number does not end")


def pack_scalar(f: FieldSchema, value: Any) -> bytes:
    if f.type == "string":
        return value.encode()
    if f.type == "bytes":
        return bytes(value)
    return struct.pack(_FORMATS[f.type], int(value) if isinstance(value, Decimal) else value)


def unpack_scalar(f: FieldSchema, data: bytes) -> Any:
    if f.type == "string":
        return data.decode("utf-8", "replace")
    if f.type == "bytes":
        return data
    got = struct.unpack(_FORMATS[f.type], data)[0]
    return Decimal(got) if f.type in ("uint64", "fixed64") else got


def key_part(f: FieldSchema, value: Any) -> bytes:
    """Text and bytes raw, integers little-endian, others as text."""
    if f.type in ("string", "bytes") or f.is_number and f.type not in ("double", "float"):
        return pack_scalar(f, value)
    return (str(value).lower() if isinstance(value, bool) else f"{value:g}").encode()


def encode_key(table_id: int, pk: bytes) -> bytes:
    return uvarint(table_id) + pk


def decode_key(key: bytes) -> tuple[int, bytes]:
    table_id, at = read_uvarint(key)
    return table_id, key[at:]


def encode_index_key(table_id: int, number: int, value: bytes, pk: bytes = b"") -> bytes:
    """Without pk: the prefix of all entries with the value."""
    return bytes([INDEX_MARK]) + uvarint(table_id) + bytes([number & 0xFF]) + value + pk


def decode_index_key(key: bytes) -> tuple[int, int, bytes]:
    """Table id, field number, and value and primary key undivided."""
    if len(key) < 3 or key[0] != INDEX_MARK:
        raise MalformedKey("no index key")
    table_id, at = read_uvarint(key, 1)
    if at >= len(key):
        raise MalformedKey("an index key without a field")
    return table_id, key[at], key[at + 1 :]


def _field_bytes(table: TableSchema, f: FieldSchema, value: Any) -> bytes:
    """A field's part of a record."""
    if f.repeated:
        parts = [pack_scalar(f, v) for v in value]
        return struct.pack("<I", len(parts)) + b"".join(p if f.width else struct.pack("<I", len(p)) + p for p in parts)
    data = pack_scalar(f, value)
    if f.width:
        return data
    if not table.compressed(f):
        return struct.pack("<I", len(data)) + data
    packed = zstd_compress(data) if len(data) >= table.compress_threshold else data
    packed = packed if len(packed) < len(data) else data
    return struct.pack("<II", len(packed), len(data)) + packed


def encode_record(table: TableSchema, record: dict, expires: int = 0, pad: bool = False) -> bytes:
    """pad: zero bytes up to `size_bound` follow, as stores write them that size their buffers before they compress."""
    out = [struct.pack("<q", expires)] if table.ttl_ns else []
    out += [_field_bytes(table, f, record[f.name]) for f in table.fields]
    whole = b"".join(out)
    return whole.ljust(size_bound(table, record), b"\0") if pad else whole


#: Fixed-width types whose columns are laid out as arrays.
_ARRAYS = {**dict.fromkeys(("int64", "sint64", "sfixed64"), "<i8"), **dict.fromkeys(("int32", "sint32", "sfixed32", "enum"), "<i4")}


def _fixed(values: pd.Series, kind: str) -> list[bytes]:
    """Every value's bytes, from one array of the column."""
    data, width = values.to_numpy().astype(kind).tobytes(), int(kind[-1])
    return [data[i : i + width] for i in range(0, len(data), width)]


def _pieces(table: TableSchema, f: FieldSchema, values: pd.Series) -> list[bytes]:
    """A field's part of every record of a column."""
    if not f.repeated and f.type in _ARRAYS and values.dtype.kind == "i":  # a column with nulls has another dtype
        return _fixed(values, _ARRAYS[f.type])
    return [_field_bytes(table, f, v) for v in values]


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise MalformedValue(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        return struct.unpack("<I", self.take(4))[0]


def _read_field(table: TableSchema, f: FieldSchema, src: _Bytes) -> Any:
    if f.repeated:
        return [unpack_scalar(f, src.take(f.width or src.number())) for _ in range(src.number())]
    if f.width:
        return unpack_scalar(f, src.take(f.width))
    if not table.compressed(f):
        return unpack_scalar(f, src.take(src.number()))
    stored, size = src.number(), src.number()
    data = src.take(stored)
    if stored != size:
        try:
            data = zstd_decompress(data, size)
        except Exception as e:
            raise MalformedValue(f"{f.name}: {e}") from e
    return unpack_scalar(f, data)


def decode_record(table: TableSchema, data: bytes) -> tuple[int, dict]:
    """Expiry and fields. Trailing bytes are padding."""
    src = _Bytes(data)
    expires = struct.unpack("<q", src.take(8))[0] if table.ttl_ns else 0
    return expires, {f.name: _read_field(table, f, src) for f in table.fields}


def decode_fields(table: TableSchema, data: bytes) -> tuple[int, list[tuple[str, str, Any]]]:
    """Expiry and (name, type, value) up to the first field that can't be read."""
    src, out, expires = _Bytes(data), [], 0
    try:
        expires = struct.unpack("<q", src.take(8))[0] if table.ttl_ns else 0
        for f in table.fields:
            out.append((f.name, f.type, _read_field(table, f, src)))
    except MalformedValue:
        pass
    return expires, out


def size_bound(table: TableSchema, record: dict) -> int:
    """Bytes that the record takes at most."""
    total = 8 if table.ttl_ns else 0
    for f in table.fields:
        v = record[f.name]
        if f.repeated:
            total += 4 + sum(f.width or 4 + len(pack_scalar(f, x)) for x in v)
        else:
            total += f.width or (COMPRESSED_HEAD if table.compressed(f) else 4) + len(pack_scalar(f, v))
    return total


# columns


def little_endian(value: Column, width: int) -> Column:
    """The low bytes of an integer, the lowest first."""
    wide = value.cast("long")
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(wide, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(width)]))


def key_part_column(f: FieldSchema, value: Column) -> Column:
    if f.type == "string":
        return F.to_binary(value, F.lit("utf-8"))
    if f.type == "bytes":
        return value
    if f.type in ("uint64", "fixed64"):
        value = F.when(value >= F.lit(str(1 << 63)).cast("decimal(20,0)"), value - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(value)
    if f.is_number and f.type not in ("double", "float"):
        return little_endian(value, f.width)
    return F.to_binary(value.cast("string"), F.lit("utf-8"))


def encode_key_column(table: TableSchema, pk: Column | None = None) -> Column:
    return F.concat(F.lit(bytearray(uvarint(table.table_id))), key_part_column(table.pk, F.col(table.primary_key) if pk is None else pk))


def encode_index_key_column(table: TableSchema, field: str) -> Column:
    f = table.field(field)
    head = bytes([INDEX_MARK]) + uvarint(table.table_id) + bytes([f.number & 0xFF])
    return F.concat(F.lit(bytearray(head)), key_part_column(f, F.col(field)), key_part_column(table.pk, F.col(table.primary_key)))


def size_column(table: TableSchema) -> Column:
    """`size_bound` as an expression, for tables without repeated fields."""
    fixed = sum(f.width or (COMPRESSED_HEAD if table.compressed(f) else 4) for f in table.fields) + (8 if table.ttl_ns else 0)
    varying = [F.octet_length(f.name).cast("long") for f in table.fields if not f.width]
    return sum(varying, F.lit(fixed).cast("long"))


def encode_records(df: DataFrame, table: TableSchema, expires: str | None = None) -> DataFrame:
    """(key, value) of every row."""
    names = [f.name for f in table.fields]
    head = uvarint(table.table_id)

    def run(frames):
        for pdf in frames:
            parts = {f.name: _pieces(table, f, pdf[f.name]) for f in table.fields}
            pk = pdf[table.primary_key]
            keys = parts[table.primary_key] if table.pk.width and table.pk.type in _ARRAYS else [key_part(table.pk, v) for v in pk]
            before = [_fixed(pdf["_e"].map(int), "<i8")] if table.ttl_ns else []
            yield pd.DataFrame({"key": [head + k for k in keys], "value": [b"".join(p) for p in zip(*before, *parts.values(), strict=True)]})

    given = df.select(*names, (F.col(expires) if expires else F.lit(0)).cast("long").alias("_e"))
    return given.mapInPandas(run, "key binary, value binary")


def decode_records(df: DataFrame, table: TableSchema, value: str = "value") -> DataFrame:
    """The records of a binary column with `_expires_at`; rows that are no records of the table are left out."""
    schema = T.StructType([T.StructField(f.name, f.spark) for f in table.fields] + [T.StructField("_expires_at", T.LongType())])

    def run(frames):
        for pdf in frames:
            rows = []
            for data in pdf["_v"]:
                try:
                    expires, fields = decode_record(table, bytes(data))
                    rows.append((*fields.values(), expires))
                except (MalformedValue, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(F.col(value).alias("_v")).mapInPandas(run, schema)


def _each(function: Callable[[bytes], Any], result: str):
    @F.pandas_udf(result)
    def apply(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else function(bytes(x)))

    return apply


def compress_column(data: Column) -> Column:
    return _each(zstd_compress, "binary")(data)


def decompress_column(data: Column, limit: int = 1 << 30) -> Column:
    return _each(lambda x: zstd_decompress(x, limit), "binary")(data)


KEY_STRUCT = "struct<kind:string,table:string,pk:string,field:string,value:string>"


def describe_key(registry: SchemaRegistry, key: bytes) -> dict:
    """kind (data, index or unknown), table, pk, field and value as text; what a table's declaration can't tell is None."""
    from .text import printable

    none = dict.fromkeys(("table", "pk", "field", "value"))
    try:
        if key[:1] == b"\xff":
            table_id, number, rest = decode_index_key(key)
            table = registry.by_id(table_id)
            f = next((x for x in table.fields if x.number == number), None) if table else None
            out = {"kind": "index", **none, "table": table.name if table else None, "field": f.name if f else None, "value": printable(rest)}
            if f:
                width = f.width if f.width and f.is_number and f.type not in ("double", "float") else 0
                tail = table.pk.width
                cut = width or (len(rest) - tail if tail else 0)
                if 0 < cut <= len(rest):
                    out |= {"value": show_scalar(f, rest[:cut]), "pk": show_scalar(table.pk, rest[cut:])}
            return out
        table_id, pk = decode_key(key)
    except MalformedKey:
        return {"kind": "unknown", **none}
    table = registry.by_id(table_id)
    if not table:
        return {"kind": "unknown", **none}
    return {"kind": "data", **none, "table": table.name, "pk": show_scalar(table.pk, pk)}


def show_scalar(f: FieldSchema, data: bytes) -> str:
    """A key part as text; bytes of another width as they can be printed."""
    from .text import printable

    if f.type == "string":
        return printable(data)
    if f.is_number and f.type not in ("double", "float") and len(data) == f.width:
        return str(unpack_scalar(f, data))
    return printable(data)


def decode_key_column(registry: SchemaRegistry, key: Column) -> Column:
    return _struct(lambda x: describe_key(registry, x), KEY_STRUCT)(key)


def _struct(function, result: str):
    names = [p.split(":")[0] for p in result[len("struct<") : -1].split(",")]

    @F.pandas_udf(result)
    def apply(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([function(bytes(x)) if x is not None else dict.fromkeys(names) for x in data], columns=names)

    return apply
