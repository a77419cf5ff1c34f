import os

import duckdb
import pytest

import __spark_entry__
from keelson.plans import catalog

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def canon(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_duckdb(spark, duck, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)
        assert {c: str(got[c].dtype) for c in got} == {c: str(want[c].dtype) for c in got}
    else:
        assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
