"""Every core query against its SQL on the smallest tables."""

import pytest
from oracle import compare, duck

from memloom.plans import catalog


@pytest.fixture(scope="session")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, sf, name):
    df = catalog.queries()[name](spark, sf)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        assert compare(df, con, sql) == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["cue_id", "engram_id", "verified", "activation", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
