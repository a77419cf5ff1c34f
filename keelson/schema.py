"""Declared tables: fields, primary key, indexes, compression and time-to-live.

A schema is declared in Python (`TableSchema.declare`) or parsed from proto3 text (`parse_proto`): messages with a table
option become tables, numbered from 1 in the order of their declaration over all given texts; messages whose name
starts with an underscore, and nested messages, do not. Option extensions are told by their last name (``table``,
``field``), whatever package declares them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import SchemaError, UnknownField

SECOND = 1_000_000_000

#: Scalar type name -> (Spark type, width in bytes or 0 if it varies, kind of number).
SCALARS = {
    "double": (T.DoubleType(), 8, "float"),
    "float": (T.FloatType(), 4, "float"),
    "int64": (T.LongType(), 8, "signed"),
    "sint64": (T.LongType(), 8, "signed"),
    "sfixed64": (T.LongType(), 8, "signed"),
    "uint64": (T.DecimalType(20, 0), 8, "unsigned"),
    "fixed64": (T.DecimalType(20, 0), 8, "unsigned"),
    "int32": (T.IntegerType(), 4, "signed"),
    "sint32": (T.IntegerType(), 4, "signed"),
    "sfixed32": (T.IntegerType(), 4, "signed"),
    "uint32": (T.LongType(), 4, "unsigned"),
    "fixed32": (T.LongType(), 4, "unsigned"),
    "bool": (T.BooleanType(), 1, ""),
    "string": (T.StringType(), 0, ""),
    "bytes": (T.BinaryType(), 0, ""),
    "enum": (T.IntegerType(), 4, "signed"),
}
INDEX_KINDS = {"NONE": "none", "NORMAL": "normal", "UNIQUE": "unique"}


@dataclass(frozen=True)
class FieldSchema:
    name: str
    type: str
    number: int
    index: str = "none"
    compress: bool = False
    repeated: bool = False
    ttl: str = ""

    def __post_init__(self):
        if self.type not in SCALARS:
            raise SchemaError(f"{self.name}: {self.type} is no field type")

    @property
    def width(self) -> int:
        return SCALARS[self.type][1]

    @property
    def is_number(self) -> bool:
        return bool(SCALARS[self.type][2])

    @property
    def spark(self) -> T.DataType:
        one = SCALARS[self.type][0]
        return T.ArrayType(one, False) if self.repeated else one


@dataclass(frozen=True)
class TableSchema:
    name: str
    fields: tuple[FieldSchema, ...]
    primary_key: str
    table_id: int = 1
    compress: bool = False
    compress_threshold: int = 256
    ttl_ns: int = 0

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if self.primary_key not in names:
            raise SchemaError(f"{self.name}: no field {self.primary_key!r} for the primary key")
        if len({n.lower() for n in names}) < len(names):
            raise SchemaError(f"{self.name}: two fields share a name")
        if uvarint(self.table_id)[0] == 0xFF:
            raise SchemaError(f"{self.name}: table id {self.table_id} would read as an index entry")

    @classmethod
    def declare(cls, name: str, fields: Iterable[FieldSchema | tuple[str, str]], primary_key: str, **more) -> TableSchema:
        made = tuple(f if isinstance(f, FieldSchema) else FieldSchema(*f, number=i) for i, f in enumerate(fields, 1))
        first = next((f.ttl for f in made if f.ttl), "")
        return cls(name, made, primary_key, **({"ttl_ns": parse_ttl(first)} if first else {}) | more)

    def field(self, name: str) -> FieldSchema:
        for f in self.fields:
            if f.name == name:
                return f
        raise UnknownField(f"{self.name} has no field {name!r}")

    @property
    def pk(self) -> FieldSchema:
        return self.field(self.primary_key)

    @property
    def indexes(self) -> list[FieldSchema]:
        return [f for f in self.fields if f.index != "none" and f.name != self.primary_key]

    def compressed(self, f: FieldSchema) -> bool:
        """Text and bytes are compressed if the field or the table says so; a repeated field never."""
        return f.type in ("string", "bytes") and not f.repeated and (f.compress or self.compress)

    @property
    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark, False) for f in self.fields])


_UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": SECOND, "m": 60 * SECOND, "h": 3600 * SECOND}


def parse_ttl(text: str) -> int:
    """Nanoseconds of whole days (``7d``) or of a duration (``1h30m``, ``500ms``); must be positive."""
    text = text.strip()
    if m := re.fullmatch(r"(-?\d+)d", text):
        total = int(m[1]) * 86400 * SECOND
    else:
        part = r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)"
        if not re.fullmatch(rf"[+-]?(?:{part})+", text):
            raise SchemaError(f"{text!r} is no time to live")
        total = round(sum(float(n) * _UNITS[u] for n, u in re.findall(part, text))) * (-1 if text[0] == "-" else 1)
    if total <= 0:
        raise SchemaError(f"time to live {text!r} is not positive")
    return total


def pascal_name(snake: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in snake.split("_"))


def lower_first(name: str) -> str:
    return name[:1].lower() + name[1:]


def uvarint(n: int) -> bytes:
    """Base-128 groups, the lowest first."""
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


_TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|(?P<text>"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\')|(?P<word>-?[A-Za-z0-9_.]+)|(?P<mark>[{}\[\]()<>=;:,])', re.S)


def _tokens(source: str) -> list[str]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise SchemaError(f"unexpected {source[at : at + 10]!r}")
        at = m.end()
        if m.lastgroup:
            out.append(m[0])
    return out


class _Reader:
    """Recursive descent over the declarations that make tables; the rest is skipped in balance."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        got = self.peek()
        if not got or wanted and got not in wanted:
            raise SchemaError(f"expected {' or '.join(wanted) or 'more'}, found {got or 'the end'!r}")
        self.at += 1
        return got

    def skip(self) -> None:
        """To the end of a statement or block."""
        depth = 0
        while True:
            t = self.take()
            depth += (t in "{[(") - (t in "}])")
            if depth == 0 and (t == ";" or t == "}"):
                return

    def constant(self):
        t = self.take()
        if t[0] in "\"'":
            return t[1:-1].encode().decode("unicode_escape") if "\\" in t else t[1:-1]
        return {"true": True, "false": False}.get(t, int(t) if re.fullmatch(r"-?\d+", t) else t)

    def option(self) -> tuple[str, dict]:
        """``(pkg.name).key = value`` or ``(pkg.name) = {key: value ...}`` or a plain one, as name and keys."""
        name = self.take()
        if name == "(":
            name = self.take().rpartition(".")[2]
            self.take(")")
        key = ""
        if self.peek().startswith("."):
            key = self.take()[1:]
        self.take("=")
        if self.peek() != "{":
            return name, {key: self.constant()}
        self.take("{")
        values = {}
        while self.peek() != "}":
            k = self.take()
            if self.peek() == ":":
                self.take()
            values[k] = self.constant()
            if self.peek() in (",", ";"):
                self.take()
        self.take("}")
        return name, values

    def field(self) -> FieldSchema | None:
        label = self.take() if self.peek() in ("repeated", "optional") else ""
        kind, name = self.take(), self.take()
        self.take("=")
        number, options = int(self.take()), {}
        if self.peek() == "[":
            self.take("[")
            while self.peek() != "]":
                ext, values = self.option()
                if ext == "field":
                    options |= values
                if self.peek() == ",":
                    self.take()
            self.take("]")
        self.take(";")
        return _Field(name, kind, number, label == "repeated", options)

    def message(self) -> _Message:
        out = _Message(self.take(), [], {}, set())
        self.take("{")
        while self.peek() != "}":
            t = self.peek()
            if t == "option":
                self.take()
                name, values = self.option()
                self.take(";")
                if name == "table":
                    out.options |= values
                    out.is_table = True
            elif t == "enum":
                self.take()
                out.enums.add(self.take())
                self.skip()
            elif t in ("message", "reserved", "extensions", "extend"):
                self.skip()
            elif t == "oneof":
                self.take(), self.take(), self.take("{")
                while self.peek() != "}":
                    out.fields.append(self.field())
                self.take("}")
            elif t == "map":
                raise SchemaError(f"{out.name}: map fields are not supported")
            elif t == ";":
                self.take()
            else:
                out.fields.append(self.field())
        self.take("}")
        return out

    def file(self) -> tuple[str, list[_Message], set[str]]:
        package, messages, enums = "", [], set()
        while t := self.peek():
            if t == "package":
                self.take()
                package = self.take()
                self.take(";")
            elif t == "message":
                self.take()
                messages.append(self.message())
            elif t == "enum":
                self.take()
                enums.add(self.take())
                self.skip()
            elif t == ";":
                self.take()
            else:
                self.skip()
        return package, messages, enums


@dataclass
class _Field:
    name: str
    kind: str
    number: int
    repeated: bool
    options: dict


@dataclass
class _Message:
    name: str
    fields: list[_Field]
    options: dict
    enums: set[str]
    is_table: bool = field(default=False)


def parse_proto(*sources: str) -> list[TableSchema]:
    """The tables that proto3 texts declare."""
    tables: list[TableSchema] = []
    for source in sources:
        _, messages, enums = _Reader(source).file()
        for m in messages:
            if m.is_table and not m.name.startswith("_"):
                tables.append(_table(m, enums | m.enums, len(tables) + 1))
    return tables


def _table(m: _Message, enums: set[str], table_id: int) -> TableSchema:
    key, fields, ttl = m.options.get("primary_key", ""), [], ""
    marked = [f.name for f in m.fields if f.options.get("primary_key") is True]
    if len({*marked, *([key] if key else [])}) > 1:
        raise SchemaError(f"{m.name}: two primary keys, {sorted({*marked, key})}")
    for f in m.fields:
        kind = "enum" if f.kind.rpartition(".")[2] in enums else f.kind
        ttl = ttl or str(f.options.get("ttl", ""))
        index = INDEX_KINDS.get(str(f.options.get("index", "NONE")).rpartition("INDEX_")[2], "none")
        fields.append(FieldSchema(f.name, kind, f.number, "none" if f.name == key else index, bool(f.options.get("compress", False)), f.repeated, str(f.options.get("ttl", ""))))
    return TableSchema(m.name, tuple(fields), key or (marked or [""])[0], table_id, bool(m.options.get("compress", False)), int(m.options.get("compress_threshold", 256)), parse_ttl(ttl) if ttl else 0)


class SchemaRegistry:
    """Tables by name, id and the bytes of a data or index key; an import replaces all tables in one step."""

    def __init__(self, tables: Iterable[TableSchema] = ()):
        self._tables = {t.name: t for t in tables}

    def import_proto(self, *sources: str) -> list[TableSchema]:
        found = parse_proto(*sources)
        self._tables = {t.name: t for t in found}
        return found

    def add(self, table: TableSchema) -> TableSchema:
        taken = {t.table_id for t in self._tables.values() if t.name != table.name}
        made = table if table.table_id not in taken else replace(table, table_id=max(taken) + 1)
        self._tables = {**self._tables, table.name: made}
        return made

    def clear(self) -> None:
        self._tables = {}

    def tables(self) -> list[TableSchema]:
        return list(self._tables.values())

    def by_name(self, name: str) -> TableSchema | None:
        return self._tables.get(name)

    def by_id(self, table_id: int) -> TableSchema | None:
        return next((t for t in self._tables.values() if t.table_id == table_id), None)

    def by_key(self, key: bytes) -> TableSchema | None:
        """The table of a data or index key; None for other bytes."""
        from .errors import MalformedKey
        from .functions import codec

        try:
            return self.by_id((codec.decode_index_key if key[:1] == b"\xff" else codec.decode_key)(key)[0])
        except MalformedKey:
            return None

    def describe(self, spark: SparkSession) -> DataFrame:
        """One row for each field: (table, table_id, field, number, type, pk, index, compress, repeated, ttl_ns)."""
        rows = [(t.name, t.table_id, f.name, f.number, f.type, f.name == t.primary_key, f.index, t.compressed(f), f.repeated, t.ttl_ns) for t in self.tables() for f in t.fields]
        return spark.createDataFrame(rows, "table string, table_id int, field string, number int, type string, pk boolean, index string, compress boolean, repeated boolean, ttl_ns long")
