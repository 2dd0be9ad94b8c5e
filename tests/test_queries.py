"""Registered queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pagewright.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(rows, names, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(round(r[k], 5) if isinstance(r[k], float) else r[k] for k in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    result = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns, order) == plain(result.fetchall(), names, order)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert df.columns and isinstance(df.count(), int)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
