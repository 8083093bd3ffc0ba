"""Every query that SQL can express, against DuckDB on the smallest driver tables."""

import decimal
import os

import duckdb
import pytest

from tallyspark.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DIR):
        pytest.skip("no driver tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    names = sorted(got.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == names
    rows = sorted(([plain(r[c]) for c in names] for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in names]
    assert rows == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=repr)
