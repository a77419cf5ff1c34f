import math

import pytest
from pyspark.sql import functions as F

from keelson.errors import UnknownField, UnsupportedOperator
from keelson.operators import indexes, paging
from keelson.operators.query import Query, next_cursor
from keelson.schema import TableSchema

from .schemas import PARCEL, PROBE, parcel, parcels


@pytest.fixture(scope="module")
def lots(spark):
    depots = ["Aalen", "Bonn", "Aalborg", "Celle", "Delft", "Emden"]
    return Query(PARCEL, parcels(spark, *[parcel(i, depot=d, stops=1000 + i) for i, d in enumerate(depots, 1)]))


def ids(q):
    return [r[q.table.primary_key] for r in q.exec().orderBy(q.table.primary_key).collect()]


def test_builder(lots):
    assert ids(lots) == [1, 2, 3, 4, 5, 6] and lots.count() == 6
    assert ids(lots.limit(1)) == [1] and lots.limit(4).count() == 4 and lots.limit(-1).count() == 6
    assert lots.first()["no"] == 1 and lots.where("depot", "=", "Zwolle").first() is None
    assert lots.predicates == ()  # the builder does not change


@pytest.mark.parametrize(
    "field,op,value,found",
    [
        ("label", "=", "L3", [3]), ("label", "!=", "L3", [1, 2, 4, 5, 6]), ("weight", ">", 2.0, [5, 6]), ("stops", "<", 1002, [1]), ("weight", ">=", 2.5, [5, 6]), ("stops", ">", 1004, [5, 6]),
        ("stops", "<=", 1001, [1]), ("depot", "LIKE", "Aal", [1, 3]), ("depot", "LIKE", "aal", []), ("depot", "LIKE", "%", []), ("fragile", "=", True, [2, 4, 6]), ("fragile", "!=", True, [1, 3, 5]), ("no", ">", 4, [5, 6]), ("depot", "PREFIX", "A", [1, 3]),
    ],
)
def test_predicates(lots, field, op, value, found):
    assert ids(lots.where(field, op, value)) == found


def test_conjunction_and_field_methods(lots):
    assert ids(lots.where_stops("=", 1002).where_fragile("=", True)) == [2]
    assert ids(lots.where_stops(">", 1002).where_stops(">", 1004)) == [5, 6]
    assert ids(lots.where_prefix("label", "L1")) == [1]
    with pytest.raises(AttributeError):
        lots.where_nothing("=", 1)


@pytest.mark.parametrize("field,op", [("depot", ">"), ("fragile", "<"), ("label", "like"), ("stops", "LIKE"), ("depot", "NOT LIKE"), ("no", "LIKE")])
def test_unsupported(lots, field, op):
    with pytest.raises(UnsupportedOperator):
        lots.where(field, op, "x")


def test_unknown_field(lots):
    with pytest.raises(UnknownField):
        lots.where("nope", "=", 1)


def test_repeated_takes_no_predicate(spark):
    q = Query(PROBE, spark.createDataFrame([], PROBE.spark))
    with pytest.raises(UnknownField):
        q.where("history", "=", 1.0)


def test_compat(lots):
    from dataclasses import replace

    q = replace(lots, compat=True)
    assert ids(q.where("stops", ">", 1002).where("stops", ">", 1004)) == [3, 4, 5, 6]  # the first value counts
    assert ids(q.where("label", ">", "A")) == [] and ids(q.where("label", "like", "L")) == []
    assert ids(q.where("label", "NOT LIKE", "L")) == [1, 2, 3, 4, 5, 6]
    assert ids(q.where("depot", "=", "A")) == [1, 3]  # the first index matches prefixes
    assert ids(q.where("fragile", "=", True).where("depot", "=", "A")) == []
    with pytest.raises(UnknownField):
        q.where("no", "=", 1)


def test_nan(spark):
    t = TableSchema.declare("t", [("id", "int64"), ("x", "double")], "id")
    df = spark.createDataFrame([(1, 1.0), (2, math.nan), (3, None)], "id long, x double")
    assert ids(Query(t, df).where("x", ">", 0.0)) == [1, 2] and ids(Query(t, df, compat=True).where("x", ">", 0.0)) == [1]
    assert ids(Query(t, df).where("x", "!=", 1.0)) == [2]  # null is unknown


def test_unsigned_64(spark):
    from decimal import Decimal

    t = TableSchema.declare("t", [("id", "int64"), ("u", "uint64")], "id")
    df = spark.createDataFrame([(1, Decimal(2**64 - 1)), (2, Decimal(5))], t.spark)
    assert ids(Query(t, df).where("u", ">", 2**63)) == [1] and ids(Query(t, df).where("u", "=", 2**64 - 1)) == [1]


def test_pages(lots):
    seen = [[r["no"] for r in p] for p in lots.pages(4)]
    assert seen == [[1, 2, 3, 4], [5, 6]]
    rows = lots.limit(2).exec().collect()
    assert next_cursor(rows, PARCEL) == 2 and ids(lots.after(2).limit(2)) == [3, 4] and ids(lots.after(99)) == [] and next_cursor([], PARCEL) is None
    assert ids(lots.after(0)) == [1, 2, 3, 4, 5, 6] and lots.after(4).count() == 2


def test_paging_operators(spark, lots):
    df = lots.exec()
    assert [r["no"] for r in paging.offset_page(df, "no", 4, 5).collect()] == [5, 6]
    assert paging.before(df, "no", 3).first()["no"] == 2 and paging.before(df, "no", 1).first() is None
    assert [r["no"] for r in paging.index_page(df, "depot", "no", 3).collect()] == [3, 1, 2]
    assert paging.scan_guard(df, 5).first().asDict() == {"total": 5, "truncated": True} and paging.scan_guard(df, 6).first().asDict() == {"total": 6, "truncated": False}
    assert [paging.clamp_limit(x) for x in (None, "x", "0", "7", 9999)] == [50, 50, 1, 7, 500]
    numbers = spark.createDataFrame([(n,) for n in (-100, -1, 0, 1, 2, 255, 256, 257, 65536)], "n long")
    assert [r["n"] for r in numbers.orderBy(*paging.physical_order(F.col("n"))).collect()] == [0, 65536, 256, 1, 257, 2, -100, 255, -1]
    placed = {r["position"]: r["n"] for r in paging.physical_positions(numbers, "n").collect()}
    assert [placed[i] for i in range(1, 10)] == [0, 65536, 256, 1, 257, 2, -100, 255, -1]


def test_plan_pushes_filters_and_prunes(spark, small):
    from keelson.plans.tables import ORDERS, query

    plan = query(spark, small, ORDERS).where("o_custkey", "=", 7).where("o_totalprice", ">=", 5.0).select("o_orderkey").exec()._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan and "GreaterThanOrEqual(o_totalprice,5.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan and "Exchange" not in plan


def test_indexes(spark, lots, tmp_path):
    df = lots.exec()
    entries = indexes.index_entries(df, "no", "stops").union(spark.createDataFrame([("stops", "1003", 77)], "a string, b string, c long"))
    assert [r["no"] for r in indexes.fetch_by_index(df, entries, "no", 1003).collect()] == [3]  # the dangling entry finds nothing
    assert indexes.violations(df, PARCEL).count() == 0
    twice = df.union(df.where("no = 1"))
    assert {(r["field"], r["value"]) for r in indexes.violations(twice, PARCEL).collect()} == {("no", "1"), ("label", "L1")}
    indexes.write_index(df, "no", "label", str(tmp_path / "i"), 2)
    assert spark.read.parquet(str(tmp_path / "i")).where("label = 'L2'").first()["no"] == 2
