"""Every query with oracle SQL against DuckDB on the smallest tables, and the others' rows."""

import pytest
from conftest import SMALL
from oracle import duck, same

from braidwork.plans import catalog


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_same_as_sql(spark, connection, name):
    assert same(catalog.QUERIES[name](spark, SMALL), catalog.ORACLES[name], connection) == ""


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_has_rows(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert round(__spark_entry__.entry(spark).first()["modularity"], 6) == -0.054704
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
