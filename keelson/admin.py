"""A read-only HTTP view of a store: ``python -m keelson.admin --dir /data/store [--proto tables.proto] [--addr 127.0.0.1:8080]``.

GET /api/keys    prefix, cursor, limit, decode          raw entries in byte order (typed rows too), with the next page's cursor
GET /api/keys    table_id, cursor, limit                rows sorted by primary key; the cursor is an offset
GET /api/keys    table_id, sort=physical, ...           the table's raw entries in byte order
GET /api/key     k (base64url)                          one entry: hex, printable, decoded key and fields
GET /api/stats                                  segments, rows and bytes of each table
GET, POST, DELETE /api/schema; GET /schema      tables; import of proto text; clear; the text
GET /metrics                                    counters in text form
"""

from __future__ import annotations

import argparse
import json
from http import HTTPStatus
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import KeelsonError, NotFound
from .operators import inspect, paging, ttl
from .schema import SchemaRegistry, uvarint
from .sources.kv import KEYSPACE
from .sources.store import Config, RecordTable, Store

MAX_BODY = 8 << 20


def parse_uint64(text: str | None, default: int = 0) -> int:
    """A decimal number of 64 bits, or the default."""
    return int(text) if text and text.isascii() and text.isdigit() and int(text) < 1 << 64 else default


def wanted_uint64(name: str, text: str | None) -> int:
    """A decimal number of 64 bits, 0 where none is given; a ValueError for other text."""
    if not text:
        return 0
    if (n := parse_uint64(text, -1)) < 0:
        raise ValueError(f"{name} is no number: {text}")
    return n


class Admin:
    """The requests, as functions from parameters to plain values."""

    def __init__(self, store: Store, registry: SchemaRegistry | None = None, max_body: int = MAX_BODY):
        self.store, self.registry, self.max_body, self.proto = store, registry or SchemaRegistry(), max_body, ""

    def _keyspace(self):
        """Raw pairs and the rows of declared tables, as one keyspace."""
        there = self.store.manifest()["tables"]
        return inspect.raw_view([(t, RecordTable(self.store, t).stored()) for t in self.registry.tables() if t.name in there], RecordTable(self.store, KEYSPACE).read())

    def keys(self, prefix: str = "", cursor: str = "", limit: str | None = None, table_id: str | None = None, decode: str = "", sort: str = "", **_) -> dict:
        number = wanted_uint64("table_id", table_id)
        table = self.registry.by_id(number) if number else None
        if number and table is None:
            raise NotFound(f"no table {table_id}")
        if table and sort == "physical":
            prefix_bytes = uvarint(table.table_id)
        else:
            prefix_bytes = prefix.encode()
        if table and sort != "physical":
            records = RecordTable(self.store, table).stored()
            guard, n, offset = paging.scan_guard(records).first(), paging.clamp_limit(limit), wanted_uint64("cursor", cursor)
            rows = [r.asDict() for r in inspect.sorted_view(records, table, offset, n).drop("_seq", "_op").collect()]
            more = offset + len(rows) < guard["total"] and len(rows) == n
            return {"entries": rows, "next_cursor": str(offset + n) if more else None, "total": guard["total"], "scan_truncated": guard["truncated"]}
        view, following = inspect.entries(self._keyspace(), self.registry, prefix_bytes, cursor, limit, decode in ("1", "true"), self.store.config.clock())
        return {"entries": [r.asDict(recursive=True) for r in view.collect()], "next_cursor": following}

    def key(self, k: str = "", **_) -> dict:
        return inspect.point_view(self._keyspace(), self.registry, inspect.key_of(k))

    def stats(self, **_) -> list[dict]:
        return [r.asDict() for r in self.store.stats().collect()]

    def schema(self, **_) -> list[dict]:
        return [r.asDict() for r in self.registry.describe(self.store.spark).orderBy("table_id", F.col("number")).collect()]

    def import_schema(self, source: str) -> list[str]:
        names = [t.name for t in self.registry.import_proto(source)]
        self.proto = source
        return names

    def clear_schema(self) -> list:
        self.registry.clear()
        self.proto = ""
        return []


def handler(admin: Admin) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, value, kind: str = "application/json") -> None:
            body = (value if isinstance(value, str) else json.dumps(value, default=_plain)).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _answer(self, routes: dict) -> None:
            url = urlsplit(self.path)
            given = {k: v[0] for k, v in parse_qs(url.query).items()}
            try:
                if url.path not in routes:
                    return self._send(HTTPStatus.NOT_FOUND, {"error": url.path})
                result = routes[url.path](**given)
                self._send(HTTPStatus.OK, result, "text/plain" if isinstance(result, str) else "application/json")
            except NotFound as e:
                self._send(HTTPStatus.NOT_FOUND, {"error": str(e)})
            except (KeelsonError, ValueError) as e:
                self._send(HTTPStatus.BAD_REQUEST, {"error": str(e)})

        def do_GET(self) -> None:
            self._answer({"/api/keys": admin.keys, "/api/key": admin.key, "/api/stats": admin.stats, "/api/schema": admin.schema, "/schema": lambda **_: admin.proto, "/metrics": lambda **_: admin.store.metrics.exposition()})

        def do_POST(self) -> None:
            size = parse_uint64(self.headers.get("Content-Length"))
            if size > admin.max_body:
                return self._send(HTTPStatus.REQUEST_ENTITY_TOO_LARGE, {"error": f"{size} bytes"})
            source = self.rfile.read(size).decode("utf-8", "replace")
            self._answer({"/api/schema": lambda **_: admin.import_schema(source)})

        def do_DELETE(self) -> None:
            self._answer({"/api/schema": lambda **_: admin.clear_schema()})

        def log_message(self, *_) -> None:
            pass

    return Handler


def _plain(value):
    return bytes(value).hex() if isinstance(value, (bytes, bytearray)) else str(value)


def serve(admin: Admin, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    if host not in ("127.0.0.1", "localhost", "::1"):
        print(f"warning: {host} can be reached from outside, and nothing here asks who is calling")
    return ThreadingHTTPServer((host, port), handler(admin))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--dir", required=True)
    parser.add_argument("--addr", default="127.0.0.1:8080")
    parser.add_argument("--proto", action="append", default=[])
    parser.add_argument("--maxbody", type=int, default=MAX_BODY)
    given = parser.parse_args(args)
    store = Store(SparkSession.builder.getOrCreate(), Config(given.dir, metrics=True, clock=ttl.now_ns), read_only=True)
    admin = Admin(store, max_body=given.maxbody)
    for path in given.proto:
        with open(path, encoding="utf-8") as f:
            admin.import_schema(f.read())
    host, _, port = given.addr.rpartition(":")
    serve(admin, host or "127.0.0.1", int(port)).serve_forever()


if __name__ == "__main__":
    main()
