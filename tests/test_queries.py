"""Every registered query against its SQL in DuckDB on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from yore.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value.isoformat() if isinstance(value, datetime.datetime) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, db, name):
    found = registry.QUERIES[name](spark, DIR)
    got = [tuple(r) for r in found.collect()]
    if name not in registry.ORACLES:
        assert found.columns
        return
    want = db.sql(registry.ORACLES[name])
    assert sorted(want.columns) == sorted(found.columns)
    assert rows_of(want.columns, want.fetchall()) == rows_of(found.columns, got)
