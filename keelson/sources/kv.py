"""Raw byte keys and values, ordered by the keys' bytes: the keyspace below the typed tables."""

from __future__ import annotations

import threading
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyKey
from ..hotcache import HotCache
from ..schema import TableSchema
from ..streaming.ingest import IngestQueue
from .store import RecordTable, Store

KEYSPACE = TableSchema.declare("_keyspace", [("key", "bytes"), ("value", "bytes")], "key")


def upper_bound(prefix: bytes) -> bytes | None:
    """The smallest key above all keys with the prefix; None if there is none."""
    trimmed = prefix.rstrip(b"\xff")
    return trimmed[:-1] + bytes([trimmed[-1] + 1]) if trimmed else None


def in_prefix(prefix: bytes, key: str = "key") -> Column:
    """The prefix as a range of keys, which Parquet's statistics can prune by."""
    c = F.col(key) >= F.lit(bytearray(prefix))
    top = upper_bound(prefix)
    return c if top is None else c & (F.col(key) < F.lit(bytearray(top)))


class KeyValueStore:
    """Point reads and writes, batches and ordered scans. Reads of hot keys are answered from memory.

    Single puts and deletes of concurrent callers go through a bounded queue, whose consumer commits them in groups of at
    most Config.batch_size; each caller waits for its group. A full queue refuses the write.
    """

    def __init__(self, store: Store):
        self.store, self.table = store, RecordTable(store, KEYSPACE)
        size = store.config.cache_bytes
        self.cache = HotCache(size or 10 << 20) if size >= 0 else None
        self.queue: IngestQueue | None = None
        self._starting = threading.Lock()
        if self.cache is not None:
            store.metrics.gauge("cache_bytes", lambda: self.cache.bytes)
            store.metrics.gauge("cache_entries", self.cache.__len__)

    def _queued(self, kind: str, key: bytes, value: bytes | None) -> None:
        with self.store.metrics.timed(kind):
            self.store.check_writable()
            key = self._key(key)
            with self._starting:
                if self.queue is None:
                    c = self.store.config
                    self.queue = IngestQueue(self, c.queue_size, c.queue_bytes, c.batch_size, self.store.metrics)
                    self.store.before_close(self.queue.stop)
            self.queue.submit(kind, key, value)

    @staticmethod
    def _key(key: bytes) -> bytes:
        if not key:
            raise EmptyKey("a key has at least one byte")
        return bytes(key)

    def put(self, key: bytes, value: bytes) -> None:
        self._queued("put", key, value)

    put_sync = put

    def delete(self, key: bytes) -> None:
        self._queued("delete", key, None)

    def write_batch(self, ops: Iterable[tuple[str, bytes, bytes | None]]) -> None:
        """All or nothing; an empty key aborts; the later operation on a key wins; the cache forgets after the commit."""
        self.store.check_open()
        ops = [(kind, self._key(key), value) for kind, key, value in ops]
        self.store.write_batch([(kind, self.table, {"key": bytearray(k), "value": bytearray(v or b"")} if kind == "put" else bytearray(k)) for kind, k, v in ops])
        if self.cache is not None:
            for _, key, _ in ops:
                self.cache.delete(key)

    def get(self, key: bytes) -> bytes | None:
        with self.store.metrics.timed("get") as told:
            value = self._get(key)
            told["result"] = "miss" if value is None else "hit"
        return value

    def _get(self, key: bytes) -> bytes | None:
        self.store.check_open()
        key = self._key(key)
        if self.cache is not None:
            hit = self.cache.get(key)
            self.store.metrics.count("cache_requests_total", result="miss" if hit is None else "hit")
            if hit is not None:
                return hit
        row = self.table.query().where("key", "=", key).first()
        if row is None:
            return None
        value = bytes(row["value"])
        if self.cache is not None:
            self.cache.record(key, value)
        return value

    def scan(self, prefix: bytes = b"") -> DataFrame:
        """(key, value) with the prefix, in byte order."""
        df = self.table.read()
        return (df.where(in_prefix(prefix)) if prefix else df).orderBy("key")

    def iterate(self, prefix: bytes):
        """Pairs with the prefix in byte order, fetched as they are consumed; none for an empty prefix."""
        if prefix:
            for row in self.scan(prefix).toLocalIterator():
                yield bytes(row["key"]), bytes(row["value"])

    def seek(self, target: bytes) -> tuple[bytes, bytes] | None:
        """The first pair at or after the target."""
        row = self.table.read().where(F.col("key") >= F.lit(bytearray(target))).orderBy("key").first()
        return (bytes(row["key"]), bytes(row["value"])) if row else None

    def seek_lt(self, target: bytes) -> tuple[bytes, bytes] | None:
        """The last pair before the target."""
        row = self.table.read().where(F.col("key") < F.lit(bytearray(target))).orderBy(F.desc("key")).first()
        return (bytes(row["key"]), bytes(row["value"])) if row else None
