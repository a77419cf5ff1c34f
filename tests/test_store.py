import threading

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.errors import ConflictingCommit, DirectoryNotEmpty, DuplicateKey, EmptyKey, KeelsonError, NotFound, QueueFull, QueueOverMemory, QueueStopped, StoreClosed
from keelson.schema import SECOND, TableSchema
from keelson.sources.kv import KeyValueStore, upper_bound
from keelson.sources.memory import MemoryTable
from keelson.sources.store import Config, Store
from keelson.streaming.ingest import IngestQueue, stream_into

from .schemas import PARCEL, PROBE, parcel, parcels

ITEM = TableSchema.declare("item", [("id", "int64"), ("name", "string")], "id")
LASTING = TableSchema.declare("lasting", [("id", "int64"), ("name", "string")], "id", ttl_ns=SECOND)


class Clock:
    now = 10 * SECOND

    def __call__(self):
        return self.now


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def store(spark, tmp_path, clock):
    return Store(spark, Config(str(tmp_path / "store"), metrics=True, clock=clock))


def items(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, name string")


def names(table, **more):
    return {r["id"]: r["name"] for r in table.read(**more).collect()}


def test_crud(spark, store):
    t = store.table(PARCEL)
    first = parcel(1, remarks="x" * 1000)
    t.put(first)
    assert t.get(1).asDict() == first and t.get(999) is None
    t.put(first | {"depot": "south", "label": "S1"})
    assert t.get(1)["depot"] == "south" and t.query().where("label", "=", "L1").count() == 0  # no stale entry
    t.remove(1)
    t.remove(1)
    assert t.get(1) is None and t.read().count() == 0
    assert store.metrics.value("ops_total", op="get", result="miss") == 2


def test_frames_strict_and_compaction(spark, store):
    t = store.table(ITEM)
    t.create(items(spark, (1, "a"), (2, "b"), (3, "c")))
    t.update(items(spark, (2, "B")))
    t.delete(items(spark, (3, "")).select("id"))
    before = names(t)
    assert before == {1: "a", 2: "B"}
    t.compact(2)
    assert names(t) == before and "Exchange" not in t.query().where("name", "=", "B").exec()._jdf.queryExecution().executedPlan().toString()
    t.create(items(spark, (1, "z"), (9, "n")))
    assert names(t) == {1: "z", 2: "B", 9: "n"}
    with pytest.raises(DuplicateKey):
        t.create(items(spark, (9, "x")), strict=True)
    with pytest.raises(NotFound):
        t.update(items(spark, (77, "x")), strict=True)
    t.create(items(spark, (10, "x")), strict=True)
    t.delete_where(t.query().where("id", ">=", 9))
    assert names(t) == {1: "z", 2: "B"}
    t.compact()
    v = store.manifest()["version"]
    assert t.compact() == v  # nothing to fold
    assert names(t) == {1: "z", 2: "B"} and store.stats().first()["tail_segments"] == 0


def test_unique_strict(spark, store):
    t = store.table(PARCEL)
    t.create(parcels(spark, parcel(1, label="same")), strict=True)
    with pytest.raises(DuplicateKey):
        t.create(parcels(spark, parcel(2, label="same")), strict=True)


def test_batch_is_atomic_and_ordered(spark, store):
    a, b = store.table(ITEM), store.table(PARCEL)
    store.write_batch([("put", a, {"id": 1, "name": "x"}), ("put", a, {"id": 1, "name": "y"}), ("put", a, {"id": 2, "name": "z"}), ("delete", a, 2), ("put", b, {"no": 5})])
    assert names(a) == {1: "y"} and b.get(5)["depot"] == ""  # missing fields are zero
    v = store.manifest()["version"]
    with pytest.raises(EmptyKey):
        store.write_batch([("put", a, {"id": 8, "name": "q"}), ("put", a, {"name": "no key"})])
    assert store.manifest()["version"] == v and names(a) == {1: "y"}


def test_snapshots_restart_and_vacuum(spark, store, tmp_path):
    t = store.table(ITEM)
    v = t.create(items(spark, *[(i, str(i)) for i in range(10)]))
    t.put({"id": 10, "name": "late"})
    assert t.read(version=v).count() == 10 and t.read().count() == 11
    t._stage(t._as_log(items(spark, (99, "orphan")), 0))  # a writer that died before its manifest
    other = Store(spark, str(tmp_path / "store"), read_only=True)
    assert names(other.table(ITEM)) == names(t) and other.table(ITEM).get(99) is None
    with pytest.raises(KeelsonError):
        other.table(ITEM).put({"id": 1, "name": "no"})
    assert store.vacuum() == 1 and t.read().count() == 11
    store.checkpoint(str(tmp_path / "copy"), v)
    assert Store(spark, str(tmp_path / "copy")).table(ITEM).read().count() == 10
    with pytest.raises(DirectoryNotEmpty):
        store.checkpoint(str(tmp_path / "copy"))
    with pytest.raises(KeelsonError):
        store.checkpoint("")


def test_close(spark, store):
    with store:
        store.table(ITEM).put({"id": 1, "name": "a"})
    for call in (store.close, lambda: store.table(ITEM).get(1), lambda: store.table(ITEM).put({"id": 1}), lambda: store.checkpoint("x")):
        with pytest.raises(StoreClosed):
            call()
    with pytest.raises(KeelsonError):
        Config("")


def test_lost_race_retries(spark, store, tmp_path):
    a, b = store.table(ITEM), Store(spark, str(tmp_path / "store")).table(ITEM)
    real, raced = store.manifest, []

    def stale(version=None):
        m = real(version)
        if not raced and version is None:
            raced.append(b.put({"id": 2, "name": "b"}))
        return m

    store.manifest = stale
    a.put({"id": 1, "name": "a"})
    assert raced and names(b) == {1: "a", 2: "b"}
    store.manifest = lambda version=None: {"version": 0, "seq": 0, "tables": {}}
    with pytest.raises(ConflictingCommit):
        a.put({"id": 3, "name": "c"})


def test_ttl(spark, store, clock):
    t = store.table(LASTING)
    t.create(items(spark, (1, "old"), (2, "refreshed")))
    clock.now += SECOND
    assert len(names(t)) == 2  # at the very time it lives
    t.update(items(spark, (2, "refreshed")))
    clock.now += 1
    t.put({"id": 3, "name": "new"})
    assert names(t) == {2: "refreshed", 3: "new"} and t.get(1) is None and t.query().where("name", "=", "old").count() == 0
    assert t.stored().count() == 3 and t.purge_expired() == 1 and t.stored().count() == 2 and t.purge_expired() == 0


def test_memory_table(spark):
    t = MemoryTable(ITEM)
    row = {"id": 1, "name": "a"}
    t.create(row)
    row["name"] = "changed"
    assert t.get(1)["name"] == "a" and t.purge_expired() == 0
    with pytest.raises(DuplicateKey):
        t.create(row)
    with pytest.raises(NotFound):
        t.update({"id": 2, "name": "b"})
    t.update(row)
    assert t.query(spark).where("name", "=", "changed").count() == 1
    t.delete(1), t.delete(1)
    assert t.get(1) is None and len(t) == 0


def test_key_value(store):
    kv = KeyValueStore(store)
    kv.write_batch([("put", b"a1", b"1"), ("put", b"a2", b"2"), ("put", b"b", b"3"), ("put", b"\xff\xff", b"4"), ("delete", b"b", None)])
    assert kv.get(b"a1") == b"1" and kv.get(b"b") is None
    assert list(kv.iterate(b"a")) == [(b"a1", b"1"), (b"a2", b"2")] and list(kv.iterate(b"")) == [] and list(kv.iterate(b"\xff")) == [(b"\xff\xff", b"4")]
    assert kv.seek(b"a2")[0] == b"a2" and kv.seek(b"a3")[0] == b"\xff\xff" and kv.seek_lt(b"a2")[0] == b"a1" and kv.seek_lt(b"a1") is None
    assert upper_bound(b"a\xff") == b"b" and upper_bound(b"\xff") is None
    kv.get(b"a1"), kv.get(b"a1")
    assert kv.cache.stats["hits"] == 1
    kv.put(b"a1", b"new")
    assert kv.get(b"a1") == b"new"
    for call in (lambda: kv.put(b"", b"x"), lambda: kv.get(b""), lambda: kv.write_batch([("put", b"q", b"1"), ("put", b"", b"2")])):
        with pytest.raises(EmptyKey):
            call()
    assert kv.get(b"q") is None


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["put", "delete", "compact"]), st.integers(0, 4), st.text("ab", max_size=3)), min_size=1, max_size=6))
def test_against_a_model(spark, tmp_path_factory, ops):
    t, model = Store(spark, str(tmp_path_factory.mktemp("m"))).table(ITEM), {}
    for op, key, name in ops:
        if op == "put":
            t.put({"id": key, "name": name})
            model[key] = name
        elif op == "delete":
            t.remove(key)
            model.pop(key, None)
        else:
            t.compact(1)
    assert names(t) == model


class Sink:
    def __init__(self):
        self.groups, self.gate = [], threading.Event()

    def write_batch(self, ops):
        self.gate.wait(10)
        if any(k == b"bad" for _, k, _ in ops):
            raise ValueError("bad")
        self.groups.append(list(ops))


def test_queue():
    sink = Sink()
    q = IngestQueue(sink, size=4, batch=3)
    first = q.offer("put", b"0", b"v")
    while len(q):
        pass
    rest = [q.offer("put", b"%d" % i, b"v") for i in range(1, 5)]
    with pytest.raises(QueueFull):
        q.offer("put", b"x", b"v")
    sink.gate.set()
    for f in (first, *rest):
        assert f.result(5) is None
    assert [len(g) for g in sink.groups] == [1, 3, 1]
    with pytest.raises(ValueError):
        q.submit("put", b"bad", b"")
    q.submit("delete", b"1")
    q.stop()
    q.stop()
    with pytest.raises(QueueStopped):
        q.offer("put", b"y", b"")
    with pytest.raises(QueueOverMemory):
        IngestQueue(Sink(), max_bytes=100).offer("put", b"k", b"v" * 200)


def test_queue_into_store(store):
    kv = KeyValueStore(store)
    q = IngestQueue(kv)
    waiting = [q.offer("put", b"k%d" % i, b"v%d" % i) for i in range(20)]
    for f in waiting:
        f.result(60)
    q.stop()
    assert kv.scan(b"k").count() == 20 and store.manifest()["version"] < 20


def test_stream_into(spark, store, tmp_path):
    t, src = store.table(ITEM), str(tmp_path / "src")
    items(spark, (1, "a"), (2, "b")).write.parquet(src)
    run = lambda: stream_into(spark.readStream.schema("id long, name string").parquet(src), lambda df, _: t.update(df), str(tmp_path / "cp")).awaitTermination()
    run()
    items(spark, (2, "B")).write.mode("append").parquet(src)
    run()
    assert names(t) == {1: "a", 2: "B"} and store.manifest()["version"] == 2


def test_rows_that_expire(spark, store, clock):
    t = store.table(PROBE)
    t.put({"tag": "p1", "reading": -4, "raw": b"xy", "mode": 2, "history": [0.5, 2.0]})
    assert t.get("p1")["history"] == [0.5, 2.0] and t.index_entries("reading").first()["index_value"] == "-4"
    clock.now += 91 * SECOND
    assert t.index_entries("reading").count() == 0 and t.stored().select(F.col("tag")).count() == 1


def test_reads_with_a_tail_push_keys_and_measure_broadcasts(spark, store):
    t = store.table(ITEM)
    t.create(items(spark, *[(i, str(i)) for i in range(50)]))
    t.compact()
    t.update(items(spark, (7, "seven")))
    plan = lambda: t.query().where("id", "=", 7).exec()._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan().splitlines() if "PushedFilters" in line]
    assert len(scans) == 3 and all("EqualTo(id,7)" in line for line in scans) and "BroadcastHashJoin" in plan() and t.get(7)["name"] == "seven"
    word = TableSchema.declare("word", [("w", "string"), ("n", "int64")], "w")
    w = store.table(word)
    w.create(spark.createDataFrame([("a" * 100, 1)], "w string, n long"))
    assert store.manifest()["tables"]["word"]["tail"][0]["key_bytes"] == 100


def test_metrics_of_a_store(spark, store):
    kv = KeyValueStore(store)
    kv.put(b"k", b"v")
    for _ in range(3):
        assert kv.get(b"k") == b"v"
    kv.delete(b"k")
    assert kv.get(b"k") is None
    t = store.table(ITEM)
    t.create(items(spark, (1, "a")))
    t.get(1)
    kv.queue._max_bytes = 0
    with pytest.raises(QueueOverMemory):
        kv.put(b"x", b"y")
    store.close()
    out = store.metrics.exposition()
    for series in (
        'ops_total{op="put",result="ok"} 1', 'ops_total{op="put",result="error"} 1', 'ops_total{op="delete",result="ok"} 1', 'ops_total{op="get",result="hit"} 4', 'ops_total{op="get",result="miss"} 1', 'ops_total{op="create",result="ok"} 1', 'ops_total{op="batch",result="ok"} 2',
        'op_duration_seconds_count{op="get"} 5', 'op_duration_seconds_bucket{op="put",le="+Inf"} 2', 'cache_requests_total{result="hit"} 1', 'cache_requests_total{result="miss"} 3', "write_throttled_total 1", "writebatch_ops_count 2", "queue_depth 0", "queue_bytes 0", "cache_bytes ", "cache_entries 0", "disk_usage_bytes ",
    ):
        assert f"keelson_{series}" in out, series
    with pytest.raises(StoreClosed):
        kv.put(b"late", b"y")


def test_concurrent_puts_share_commits(store):
    from concurrent.futures import ThreadPoolExecutor

    kv = KeyValueStore(store)
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda i: kv.put(b"k%02d" % i, b"v"), range(40)))
    assert kv.scan(b"k").count() == 40 and store.manifest()["version"] < 20
