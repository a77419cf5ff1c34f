from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keelson.errors import MalformedKey, MalformedValue, NotFound
from keelson.functions import codec, sketch, text
from keelson.hotcache import HotCache
from keelson.metrics import Metrics, bucket_counts
from keelson.operators import inspect
from keelson.schema import SchemaRegistry, TableSchema

from .schemas import PARCEL, PROBE, TEXT, parcel, parcels

POINT = TableSchema.declare("Point", [("x", "double"), ("y", "double"), ("z", "float")], "x")
WIDE = TableSchema.declare("Wide", [("id", "uint64"), ("a", "int32"), ("b", "uint32"), ("c", "bool"), ("d", "bytes"), ("e", "sint64")], "id")
RECORD = parcel(7, depot="harbour", remarks="keep dry", label="H/7", fragile=True)


@pytest.mark.parametrize("table_id", [0, 1, 42, 7, 2**63 - 1])
@pytest.mark.parametrize("pk", [b"text", b"", b"\x00\xff\x80"])
def test_key_round_trip(table_id, pk):
    assert codec.decode_key(codec.encode_key(table_id, pk)) == (table_id, pk)


def test_index_keys():
    key = codec.encode_index_key(300, 3, b"val", b"pk")
    assert key == b"\xff\xac\x02\x03valpk" and codec.decode_index_key(key) == (300, 3, b"valpk") and key.startswith(codec.encode_index_key(300, 3, b"val"))
    for bad in (b"", b"\xff", b"\xff\x01", b"\x01\x02\x03", b"\xff\x80\x80"):
        with pytest.raises(MalformedKey):
            codec.decode_index_key(bad)
    for bad in (b"", b"\x80"):
        with pytest.raises(MalformedKey):
            codec.decode_key(bad)


def test_record_layout():
    data, n = codec.encode_record(PARCEL, RECORD, pad=True), (7).to_bytes(4, "little")
    plain = n + bytes(4) + n + b"harbour" + b"\0\0\0\0\0\0\x0c\x40" + (8).to_bytes(4, "little") * 2 + b"keep dry" + (3).to_bytes(4, "little") + b"H/7" + n + b"\1"
    assert codec.encode_record(PARCEL, RECORD) == plain and data.startswith(plain) and len(data) == codec.size_bound(PARCEL, RECORD) and not any(data[len(plain) :])
    assert codec.decode_record(PARCEL, data + b"\0" * 9) == (0, RECORD)  # padding may follow
    assert len(codec.encode_record(POINT, {"x": 1.0, "y": 2.0, "z": 3.0})) == 20
    long = RECORD | {"remarks": "many words éü " * 100}
    packed = codec.encode_record(PARCEL, long)
    assert len(packed) < 300 < codec.size_bound(PARCEL, long) and codec.decode_record(PARCEL, packed)[1] == long
    probe = {"tag": "p1", "reading": -9, "raw": b"\0x", "mode": 2, "history": [0.5, -1.0]}
    assert codec.encode_record(PROBE, probe)[:8] == bytes(8) and codec.decode_record(PROBE, codec.encode_record(PROBE, probe, 99)) == (99, probe)
    wide = {"id": Decimal(2**64 - 1), "a": -5, "b": 2**32 - 1, "c": True, "d": b"\x00\x01", "e": -(2**63)}
    assert codec.decode_record(WIDE, codec.encode_record(WIDE, wide))[1] == wide


def test_damaged_records():
    data = codec.encode_record(PARCEL, RECORD)
    for n in (0, 3, 20, len(data) - 1):
        with pytest.raises(MalformedValue):
            codec.decode_record(PARCEL, data[:n])
    assert [f[0] for f in codec.decode_fields(PARCEL, data[:30])[1]] == ["no", "depot", "weight"]


def test_columns_agree(spark):
    df = parcels(spark, RECORD, parcel(-1, depot="é", label="", stops=2**32 - 1, remarks="b" * 999))
    got = df.select("no", codec.encode_key_column(PARCEL).alias("k"), codec.encode_index_key_column(PARCEL, "stops").alias("i"), codec.encode_index_key_column(PARCEL, "label").alias("e"), codec.size_column(PARCEL).alias("n")).collect()
    for r, row in zip(got, df.collect(), strict=True):
        pk = codec.key_part(PARCEL.pk, row["no"])
        assert bytes(r["k"]) == codec.encode_key(1, pk) and bytes(r["i"]) == codec.encode_index_key(1, 7, codec.key_part(PARCEL.field("stops"), row["stops"]), pk)
        assert bytes(r["e"]) == codec.encode_index_key(1, 6, row["label"].encode(), pk) and r["n"] == codec.size_bound(PARCEL, row.asDict())
    big = spark.createDataFrame([(Decimal(2**64 - 2),)], "id decimal(20,0)")
    assert bytes(big.select(codec.encode_key_column(WIDE)).first()[0]) == codec.encode_key(1, (2**64 - 2).to_bytes(8, "little"))
    kv = codec.encode_records(df, PARCEL)
    assert sorted((bytes(r["key"]), bytes(r["value"])) for r in kv.collect()) == sorted((codec.encode_key(1, codec.key_part(PARCEL.pk, r["no"])), codec.encode_record(PARCEL, r.asDict())) for r in df.collect())
    damaged = kv.union(spark.createDataFrame([(bytearray(b"k"), bytearray(b"zz")), (bytearray(b"k"), None)], kv.schema))
    assert sorted(codec.decode_records(damaged, PARCEL).drop("_expires_at").collect()) == sorted(df.collect())
    z = df.select(codec.decompress_column(codec.compress_column(F.to_binary("remarks", F.lit("utf-8")))).cast("string").alias("remarks"), "no")
    assert {r["remarks"] for r in z.collect()} == {"keep dry", "b" * 999}


def test_describe_keys():
    reg = SchemaRegistry()
    reg.import_proto(TEXT)
    d = lambda k: codec.describe_key(reg, k)
    assert d(codec.encode_key(1, (5).to_bytes(8, "little"))) == {"kind": "data", "table": "Parcel", "pk": "5", "field": None, "value": None}
    assert d(codec.encode_index_key(1, 7, (9).to_bytes(4, "little"), (5).to_bytes(8, "little")))["value"] == "9"
    assert d(codec.encode_index_key(1, 6, b"L-5", (5).to_bytes(8, "little"))) == {"kind": "index", "table": "Parcel", "pk": "5", "field": "label", "value": "L-5"}
    assert d(codec.encode_index_key(9, 3, b"a"))["kind"] == "index" and d(b"\x09x")["kind"] == "unknown" and d(b"")["kind"] == "unknown"
    assert d(codec.encode_key(1, b"\x01"))["pk"] == "\\x01"


def test_text():
    assert text.printable(b"ab\n\xff\xc3\xa9\x7f") == "ab\\x0a\\xffé\\x7f" and text.preview(b"x" * 300) == "x" * 256 + "…" and text.preview("é".encode() * 200).endswith("…")
    assert text.printable("é ok".encode()) == "é ok" and text.printable(b"\t") == "\\x09" and text.preview(b"a\tb\n") == "a\tb\n" and text.preview(b"a\x00") == "a\\x00"
    assert text.preview(b"a\xff") == "a\\xff" and text.preview(b"") == ""


def test_text_columns(spark):
    df = spark.createDataFrame([(bytearray(b"\xfb\xff\x00"),), (None,)], "b binary")
    r = df.select(text.hex_dump(F.col("b")).alias("h"), text.base64url(F.col("b")).alias("u"), text.printable_column(F.col("b")).alias("p"), text.truncated(F.col("b"), 2).alias("t"), text.preview_column(F.col("b")).alias("v")).collect()
    assert r[0].asDict() == {"h": "fbff00", "u": "-_8A", "p": "\\xfb\\xff\\x00", "t": True, "v": "\\xfb\\xff\\x00"} and r[1]["p"] is None


def test_views(spark):
    reg = SchemaRegistry()
    reg.import_proto(TEXT)
    lots = parcels(spark, *[parcel(i) for i in range(5)])
    kv = codec.encode_records(lots, PARCEL)
    view, cursor = inspect.entries(kv, reg, b"\x01", limit=3)
    assert [r["decoded"]["pk"] for r in view.collect()] == ["0", "1", "2"] and cursor
    view, cursor = inspect.entries(kv, reg, b"\x01", cursor, 3)
    assert [r["decoded"]["pk"] for r in view.collect()] == ["3", "4"] and cursor is None
    point = inspect.point_view(kv, reg, codec.encode_key(1, (2).to_bytes(8, "little")))
    assert ("label", "string", "L2") in point["fields"] and not point["truncated"] and not point["expired"]
    with pytest.raises(NotFound):
        inspect.point_view(kv, reg, b"nope")
    assert [r["no"] for r in inspect.sorted_view(lots, PARCEL, 3, 10).collect()] == [3, 4]
    entry = spark.createDataFrame([(bytearray(codec.encode_index_key(1, 6, b"L2")), bytearray((2).to_bytes(8, "little")))], kv.schema)
    assert inspect.point_view(entry, reg, codec.encode_index_key(1, 6, b"L2"))["decoded"]["pk"] == "2"


def test_folder_stats(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"12345")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/b").write_bytes(b"1")
    assert inspect.folder_stats(spark, str(tmp_path)).first().asDict() == {"files": 2, "bytes": 6}


def test_hot_cache():
    now = [0.0]
    c = HotCache(1000, ttl=10, clock=lambda: now[0])
    c.record(b"k", b"v")
    assert c.get(b"k") is None
    c.record(b"k", b"v")
    assert c.get(b"k") == b"v"
    now[0] = 9
    assert c.get(b"k") == b"v"
    now[0] = 18
    assert c.get(b"k") == b"v"  # each hit lengthens its life
    now[0] = 40
    assert c.get(b"k") is None and c.stats["expirations"] == 1
    assert not c.set(b"big", b"x" * 2000) and c.stats["rejections"] == 1
    for i in range(5):
        c.set(b"%d" % i, b"x" * 100)
    assert len(c) == 4 and c.get(b"0") is None and c.stats["evictions"] == 1 and c.bytes <= 1000
    now[0] = 100
    assert c.sweep() == 4 and len(c) == 0 and c.bytes == 0


def test_sketches(spark):
    s = sketch.CountMinSketch(age_after=1000)
    for i in range(900):
        s.add(b"%d" % (i % 30))
    assert s.estimate(b"7") >= 30 and s.estimate(b"never") <= 30
    for _ in range(100):
        s.add(b"7")
    assert 65 <= s.estimate(b"7") <= 70  # aged once
    assert sketch.fnv1a64(b"") == 0xCBF29CE484222325 and sketch.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert len(spark.range(10).agg(sketch.frequency_sketch("id")).first()[0]) > 4 * 2048


def test_metrics(spark):
    off, on = Metrics(), Metrics(True, "ns")
    off.count("ops_total")
    assert off.exposition() == ""
    with on.timed("put"):
        pass
    with pytest.raises(ValueError), on.timed("put"):
        raise ValueError
    on.gauge("queue_depth", lambda: 3)
    out = on.exposition()
    assert 'ns_ops_total{op="put",result="ok"} 1' in out and 'ns_ops_total{op="put",result="error"} 1' in out and "ns_queue_depth 3" in out and 'ns_op_duration_seconds_count{op="put"} 2' in out and 'le="+Inf"' in out
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (1e9,), (None,)], "v double")
    assert {r["bucket"]: r["n"] for r in bucket_counts(df, "v").collect()} == {0: 2, 1: 1, 2: 1, 11: 1}
