"""Every registered query that has SQL gives the rows of that SQL."""

import duckdb
import pytest

from lodestone.plans import registry
from tools.compare import TABLES, rows

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.ORACLES:
        rel = con.sql(registry.ORACLES[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert mine == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
