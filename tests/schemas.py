"""Two declared tables that the tests share: parcels of a depot, and readings of a probe that expire."""

from keelson.schema import parse_proto

TEXT = """
syntax = "proto3";
package depot; // one file, two tables
option go_package = "example.com/depot;depot";
import "records/options.proto";

/* what lies in a depot */
message Parcel {
  option (records.table) = {primary_key: "no"};
  int64 no = 1;
  string depot = 2 [(records.field).index = INDEX_NORMAL];
  double weight = 3;
  string remarks = 4 [(records.field).compress = true, deprecated = true];
  string label = 6 [(records.field) = {index: INDEX_UNIQUE}];
  uint32 stops = 7 [(records.field).index = INDEX_NORMAL];
  bool fragile = 9;
}
message _Draft { option (records.table).primary_key = "no"; int64 no = 1; }
message Probe {
  option (records.table) = {compress_threshold: 10};
  message Place { int64 x = 1; }
  enum Mode { IDLE = 0; BUSY = 2; }
  string tag = 1 [(records.field).primary_key = true];
  sint64 reading = 2 [(records.field).index = INDEX_NORMAL];
  bytes raw = 5 [(records.field) = {ttl: "90s"}];
  Mode mode = 6;
  repeated double history = 8;
}
"""

PARCEL, PROBE = parse_proto(TEXT)


def parcel(no: int, **more) -> dict:
    return {"no": no, "depot": "north", "weight": 0.5 * no, "remarks": "dry", "label": f"L{no}", "stops": no, "fragile": no % 2 == 0, **more}


def parcels(spark, *records: dict):
    return spark.createDataFrame([tuple(r.values()) for r in records], PARCEL.spark)
