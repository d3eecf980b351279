"""Every registered query against its DuckDB oracle on sf0.001 (the same
check the driver runs at sf0.01), plus the entry smoke test."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from pagelane.plans import catalog
from pagelane.sources.tables import TABLES, table_path
from tools.compare import digest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["c_custkey", "n_pages", "markdown"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(entry.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(rows) == len(d_rows)
    assert digest(df.columns, rows) == digest(d_cols, d_rows)
