"""Queries that SQL can say, against DuckDB on whole tables."""

import duckdb
import pytest

from yore.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.ORACLES)
def test_equal_to_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = db.sql(registry.ORACLES[name])
    found = registry.QUERIES[name](spark, DIR)
    assert sorted(found.columns) == sorted(want.columns)
    rows = found.select(*want.columns).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(want.fetchall(), key=str)
