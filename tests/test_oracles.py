"""Every query of the catalog against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from markwright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    result = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))
