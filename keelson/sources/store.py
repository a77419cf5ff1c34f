"""The record store: tables as logs of Parquet segments under one manifest.

A commit writes its segments first and then one new manifest; a manifest is a whole file under a new number, so readers
see all of a batch or nothing, an interrupted writer leaves only segments that no manifest names, and each manifest
is a snapshot. Reading merges the compacted base with the newer tail (`operators.merge`); `compact` folds the tail into
a base sorted by primary key, from which a read is a plain scan with pushed filters.

One writer at a time commits; a writer that lost the race retries its manifest against the new one.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConflictingCommit, DirectoryNotEmpty, DuplicateKey, EmptyKey, KeelsonError, NotFound, StoreClosed
from ..metrics import Metrics
from ..operators import indexes, merge, ttl
from ..operators.query import Query
from ..schema import TableSchema
from .files import Files

_MANIFEST = "manifest-{:012d}.json"


@dataclass
class Config:
    """root is required. Durability is Parquet's and the file system's; the queue's sizes hold for raw writes in groups."""

    root: str
    metrics: bool = False
    namespace: str = "keelson"
    cache_bytes: int = 10 << 20
    batch_size: int = 64
    queue_size: int = 1024
    queue_bytes: int = 64 << 20
    keep_manifests: int = 100
    clock: Callable[[], int] = field(default=ttl.now_ns)

    def __post_init__(self):
        if not self.root:
            raise KeelsonError("a store needs a root folder")


def log_schema(table: TableSchema) -> T.StructType:
    hidden = [T.StructField(merge.SEQ, T.LongType()), T.StructField(merge.OP, T.ByteType()), T.StructField(ttl.EXPIRES, T.LongType())]
    return T.StructType(hidden + [T.StructField(f.name, f.spark) for f in table.fields])


class Store:
    """All tables below one root."""

    def __init__(self, spark: SparkSession, config: Config | str, read_only: bool = False):
        self.spark, self.config = spark, Config(config) if isinstance(config, str) else config
        self.files, self.read_only = Files(spark, self.config.root), read_only
        self.metrics = Metrics(self.config.metrics, self.config.namespace)
        self._lock, self._closed, self._on_close = threading.RLock(), False, []
        self.metrics.gauge("disk_usage_bytes", self.files.size)
        if not read_only:
            self.files.make()

    def close(self) -> None:
        """Once; a second close is an error."""
        self.check_open()
        for end in self._on_close:
            end()
        self._closed = True

    def before_close(self, end: Callable[[], None]) -> None:
        """Calls end when the store closes, while it still takes writes."""
        self._on_close.append(end)

    def check_open(self) -> None:
        if self._closed:
            raise StoreClosed(self.config.root)

    def check_writable(self) -> None:
        self.check_open()
        if self.read_only:
            raise KeelsonError("the store is open for reading only")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        if not self._closed:
            self.close()

    def table(self, schema: TableSchema) -> RecordTable:
        return RecordTable(self, schema)

    # manifests

    def versions(self) -> list[int]:
        return [int(n[9:21]) for n in self.files.list() if n.startswith("manifest-")]

    def manifest(self, version: int | None = None) -> dict:
        self.check_open()
        if version is None:
            version = max(self.versions(), default=0)
        return json.loads(self.files.read(_MANIFEST.format(version))) if version else {"version": 0, "seq": 0, "tables": {}}

    def commit(self, change: Callable[[dict], None], attempts: int = 20) -> int:
        """Applies a change to the newest manifest and publishes it under the next number."""
        self.check_writable()
        with self._lock:
            for _ in range(attempts):
                m = self.manifest()
                change(m)
                m["version"] += 1
                if self.files.write_new(_MANIFEST.format(m["version"]), json.dumps(m)):
                    for old in self.versions()[: -self.config.keep_manifests]:
                        self.files.delete(_MANIFEST.format(old))
                    return m["version"]
        raise ConflictingCommit(f"after {attempts} attempts")

    def write_batch(self, ops: Iterable[tuple[str, RecordTable, Any]]) -> int:
        """All of ("put", table, record) and ("delete", table, pk) or nothing; the later of two on one key wins."""
        with self.metrics.timed("batch"):
            return self._write_batch(ops)

    def _write_batch(self, ops: Iterable[tuple[str, RecordTable, Any]]) -> int:
        self.check_writable()
        by_table: dict[str, tuple[RecordTable, list]] = {}
        for order, (kind, table, what) in enumerate(ops):
            if what is None:
                raise EmptyKey(f"{table.schema.name}: nothing to {kind}")
            by_table.setdefault(table.schema.name, (table, []))[1].append(table._log_row(kind, what, order))
        staged = [(t, t._stage(self.spark.createDataFrame(rows, log_schema(t.schema)), 1), len(rows)) for t, rows in by_table.values()]

        def publish(m: dict) -> None:
            for t, part, _ in staged:
                t._entry(m)["tail"].append({**part, "seq": m["seq"]})
            m["seq"] += max((n for *_, n in staged), default=0) + 1

        return self.commit(publish)

    # whole-store operations

    def checkpoint(self, target: str, version: int | None = None) -> int:
        """Copies one snapshot's files to a new or empty directory; writers go on meanwhile."""
        self.check_open()
        if not target:
            raise KeelsonError("a checkpoint needs a directory")
        other = Files(self.spark, target)
        if other.list():
            raise DirectoryNotEmpty(target)
        m = self.manifest(version)
        other.make()
        for entry in m["tables"].values():
            for part in [*entry["base"], *entry["tail"]]:
                other.make(part["path"].rpartition("/")[0])
                self.files.copy_to(part["path"], other)
        other.write_new(_MANIFEST.format(max(1, m["version"])), json.dumps(m))
        return m["version"]

    backup_to = checkpoint

    def stats(self) -> DataFrame:
        """One row for each table: base and tail segments, rows written and bytes."""
        rows = [(name, len(e["base"]), len(e["tail"]), sum(p["rows"] for p in [*e["base"], *e["tail"]]), sum(self.files.size(p["path"]) for p in [*e["base"], *e["tail"]])) for name, e in self.manifest()["tables"].items()]
        return self.spark.createDataFrame(rows, "table string, base_segments int, tail_segments int, rows_written long, bytes long")

    def vacuum(self) -> int:
        """Deletes segments that no kept manifest names (interrupted writes, compacted tails); returns how many."""
        self.check_open()
        named = {p["path"] for v in self.versions() for e in self.manifest(v)["tables"].values() for p in [*e["base"], *e["tail"]]}
        gone = 0
        for table in self.files.list("tables"):
            for segment in self.files.list(f"tables/{table}"):
                if f"tables/{table}/{segment}" not in named:
                    self.files.delete(f"tables/{table}/{segment}")
                    gone += 1
        return gone


class RecordTable:
    """Reads, queries and writes of one declared table."""

    def __init__(self, store: Store, schema: TableSchema):
        self.store, self.schema, self.spark = store, schema, store.spark

    # reads

    def _entry(self, m: dict) -> dict:
        return m["tables"].setdefault(self.schema.name, {"base": [], "tail": []})

    def _load(self, parts: list[dict]) -> DataFrame | None:
        out = None
        for part in parts:
            df = self.spark.read.schema(log_schema(self.schema)).parquet(self.store.files.path(part["path"]))
            df = df.withColumn(merge.SEQ, F.col(merge.SEQ) + part["seq"])
            out = df if out is None else out.unionByName(df)
        return out

    def stored(self, version: int | None = None) -> DataFrame:
        """Records as they stand, expired ones too, with the hidden columns."""
        entry = self._entry(self.store.manifest(version))
        base, tail = self._load(entry["base"]), self._load(entry["tail"])
        if base is None and tail is None:
            return self.spark.createDataFrame([], log_schema(self.schema))
        known = all("key_bytes" in p for p in entry["tail"])
        tail_bytes = sum(p["key_bytes"] + merge.ROW_BYTES * p["rows"] for p in entry["tail"]) if known else None
        return merge.merge(base, tail, self.schema.primary_key, tail_bytes)

    def query(self, version: int | None = None, now: int | None = None, compat: bool = False) -> Query:
        return Query(self.schema, self.stored(version), now=self.store.config.clock() if now is None else now, compat=compat)

    def read(self, version: int | None = None, now: int | None = None) -> DataFrame:
        return self.query(version, now).exec()

    def get(self, pk: Any) -> Row | None:
        with self.store.metrics.timed("get") as told:
            row = self.query().where(self.schema.primary_key, "=", pk).first()
            told["result"] = "hit" if row else "miss"
        return row

    def index_entries(self, field: str) -> DataFrame:
        return indexes.index_entries(self.read(), self.schema.primary_key, field)

    # writes

    def _log_row(self, kind: str, what: Any, order: int) -> tuple:
        s = self.schema
        if kind == "delete":
            return (order, merge.DELETE, 0, *[what if f.name == s.primary_key else None for f in s.fields])
        got = what.asDict() if isinstance(what, Row) else dict(what)
        if got.get(s.primary_key) is None:
            raise EmptyKey(f"{s.name}: a record without {s.primary_key}")
        expires = self.store.config.clock() + s.ttl_ns if s.ttl_ns else 0
        return (order, merge.PUT, expires, *[got.get(f.name, _zero(f)) for f in s.fields])

    def _stage(self, log: DataFrame, files: int | None = None) -> dict:
        """Writes a segment that no manifest names yet; its path, rows and the bytes of its keys."""
        self.store.check_writable()
        path = f"tables/{self.schema.name}/{uuid.uuid4().hex}"
        (log.coalesce(files) if files else log).write.option("compression", "zstd").parquet(self.store.files.path(path))
        written, pk = self.spark.read.schema(log.schema).parquet(self.store.files.path(path)), self.schema.pk
        width = F.lit(16) if pk.width else F.octet_length(pk.name)
        size = written.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("key_bytes")).first()
        return {"path": path, "rows": size["rows"], "key_bytes": size["key_bytes"]}

    def _append(self, log: DataFrame, kind: str) -> int:
        with self.store.metrics.timed(kind):
            part = self._stage(log)

            def publish(m: dict) -> None:
                self._entry(m)["tail"].append({**part, "seq": m["seq"]})
                m["seq"] += 1

            return self.store.commit(publish)

    def _as_log(self, df: DataFrame, op: int) -> DataFrame:
        s, now = self.schema, self.store.config.clock()
        hidden = [F.lit(0).cast("long").alias(merge.SEQ), F.lit(op).cast("byte").alias(merge.OP), F.lit(now + s.ttl_ns if s.ttl_ns and op == merge.PUT else 0).cast("long").alias(ttl.EXPIRES)]
        fields = [(F.col(f.name) if op == merge.PUT or f.name == s.primary_key else F.lit(None)).cast(f.spark).alias(f.name) for f in s.fields]
        return df.select(*hidden, *fields)

    def create(self, records: DataFrame, strict: bool = False) -> int:
        """Puts all rows in one commit. strict: an existing or repeated key, or a unique value twice, is an error."""
        if strict:
            pk = self.schema.primary_key
            together = self.read().unionByName(records.select(*[f.name for f in self.schema.fields]))
            if bad := indexes.violations(together, self.schema).limit(3).collect():
                raise DuplicateKey(f"{self.schema.name}: {[(r['field'], r['value']) for r in bad]}" + f" (key {pk})")
        return self._append(self._as_log(records, merge.PUT), "create")

    def update(self, records: DataFrame, strict: bool = False) -> int:
        """Puts all rows and restarts their time to live. strict: a key without a record is an error."""
        pk = self.schema.primary_key
        if strict and (bad := records.join(self.read().select(pk), pk, "left_anti").select(pk).limit(3).collect()):
            raise NotFound(f"{self.schema.name}: no record {[r[pk] for r in bad]}")
        return self._append(self._as_log(records, merge.PUT), "update")

    def delete(self, keys: DataFrame) -> int:
        """Removes the records of a DataFrame's keys; missing ones are no error."""
        return self._append(self._as_log(keys, merge.DELETE), "delete")

    def delete_where(self, query: Query) -> int:
        return self.delete(query.select(self.schema.primary_key).exec())

    def put(self, record: dict | Row) -> int:
        return self.store.write_batch([("put", self, record)])

    def remove(self, pk: Any) -> int:
        return self.store.write_batch([("delete", self, pk)])

    def purge_expired(self, now: int | None = None) -> int:
        """Removes records whose time is past; returns how many there were. One clock reading for all rows."""
        now = self.store.config.clock() if now is None else now
        gone = ttl.expired(self.stored(), now).select(self.schema.primary_key)
        n = gone.count()
        if n:
            self.delete(gone)
        return n

    def compact(self, partitions: int | None = None) -> int:
        """Folds the tail into a base of one put for each key, sorted by key; later appends are kept."""
        entry = self._entry(self.store.manifest())
        folded = {p["path"] for p in [*entry["base"], *entry["tail"]]}
        if not entry["tail"]:
            return self.store.manifest()["version"]
        pk = self.schema.primary_key
        whole = self.stored().withColumn(merge.SEQ, F.lit(0).cast("long"))
        dealt = whole.repartitionByRange(partitions, pk) if partitions else whole.repartitionByRange(pk)
        part = self._stage(dealt.sortWithinPartitions(pk))

        def publish(m: dict) -> None:
            now = self._entry(m)
            if not folded <= {p["path"] for p in [*now["base"], *now["tail"]]}:
                raise ConflictingCommit("another compaction came first")
            now["base"], now["tail"] = [{**part, "seq": 0}], [p for p in now["tail"] if p["path"] not in folded]

        return self.store.commit(publish)


def _zero(f) -> Any:
    """A missing field is its zero value."""
    if f.repeated:
        return []
    from decimal import Decimal

    return {"string": "", "bytes": b"", "bool": False, "double": 0.0, "float": 0.0, "uint64": Decimal(0), "fixed64": Decimal(0)}.get(f.type, 0)
