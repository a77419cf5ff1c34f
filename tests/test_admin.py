import json
import threading
import urllib.error
import urllib.request

import pytest

from keelson.admin import Admin, parse_uint64, serve
from keelson.functions import codec
from keelson.operators import inspect
from keelson.sources.kv import KeyValueStore
from keelson.sources.store import Config, Store

from .schemas import PARCEL, TEXT, parcel, parcels


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    store = Store(spark, Config(str(tmp_path_factory.mktemp("s")), metrics=True))
    store.table(PARCEL).create(parcels(spark, *[parcel(i) for i in range(300, 305)]))
    KeyValueStore(store).write_batch([("put", b"plain", b"text"), ("put", codec.encode_index_key(1, 6, b"L300"), (300).to_bytes(8, "little"))])
    server = serve(Admin(store, max_body=10_000), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, data=None, method=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data, method=method), timeout=60) as r:
                body = r.read().decode()
                return r.status, json.loads(body) if r.headers["Content-Type"] == "application/json" else body
        except urllib.error.HTTPError as e:
            return e.code, None

    yield ask
    server.shutdown()


def test_schema(site):
    assert site("/api/schema") == (200, [])
    assert site("/api/schema", TEXT.encode()) == (200, ["Parcel", "Probe"])
    assert [r["field"] for r in site("/api/schema")[1] if r["pk"]] == ["no", "tag"] and site("/schema")[1] == TEXT
    assert site("/api/schema", b"message X {")[0] == 400 and site("/api/schema", b" " * 20_000)[0] == 413


def test_pages(site):
    site("/api/schema", TEXT.encode())
    _, one = site("/api/keys?limit=3&prefix=%01")
    _, two = site(f"/api/keys?limit=9&cursor={one['next_cursor']}")
    every = one["entries"] + two["entries"]
    assert [e["decoded"]["pk"] for e in every[:5]] == ["300", "301", "302", "303", "304"] and [e["decoded"]["kind"] for e in every[5:]] == ["unknown", "index"] and two["next_cursor"] is None
    _, rows = site("/api/keys?table_id=1&limit=4")
    assert [e["no"] for e in rows["entries"]] == [300, 301, 302, 303] and rows["next_cursor"] == "4" and rows["total"] == 5 and not rows["scan_truncated"]
    _, rest = site("/api/keys?table_id=1&limit=4&cursor=4")
    assert [e["no"] for e in rest["entries"]] == [304] and rest["next_cursor"] is None
    _, physical = site("/api/keys?table_id=1&sort=physical&decode=1&limit=2")
    assert [e["decoded"]["pk"] for e in physical["entries"]] == ["300", "301"] and physical["entries"][1]["row"]["fields"][4] == {"name": "label", "type": "string", "value": "L301"} and not physical["entries"][0]["row"]["expired"]
    assert site("/api/keys?table_id=77")[0] == 404 and [site(f"/api/keys?{q}")[0] for q in ("table_id=x", "table_id=1&cursor=-1", "cursor=%21%21")] == [400, 400, 400]


def test_one_key_stats_and_metrics(site):
    site("/api/schema", TEXT.encode())
    key = inspect.cursor_of(codec.encode_key(1, (303).to_bytes(8, "little")))
    _, got = site(f"/api/key?k={key}")
    assert ["label", "string", "L303"] in got["fields"] and got["decoded"]["table"] == "Parcel"
    assert site("/api/key?k=AAAA")[0] == 404 and site("/nothing")[0] == 404
    assert {r["table"] for r in site("/api/stats")[1]} == {"Parcel", "_keyspace"}
    assert 'keelson_ops_total{op="batch",result="ok"} 1' in site("/metrics")[1]
    assert site("/api/schema", method="DELETE") == (200, [])


def test_numbers():
    assert [parse_uint64(x, 9) for x in ("7", "", None, "x", "-1", str(1 << 64))] == [7, 9, 9, 9, 9, 9]
