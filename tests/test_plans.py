"""Every query with SQL equals DuckDB's answer on the smallest tables; those without have rows and a schema."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from ondaframe import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (bool, str)):
        return str(x)
    return round(float(x), 8) + 0.0


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("key", sorted(plans.ORACLE_SQL))
def test_as_duckdb(spark, duck, key):
    got = plans.QUERIES[key](spark, SF)
    want = duck.execute(plans.ORACLE_SQL[key])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("key", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_has_rows(spark, key):
    assert plans.QUERIES[key](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
