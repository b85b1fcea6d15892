"""Every corpus query with oracle SQL against DuckDB, and the others' shape, on the smallest tables."""

import pytest
from conftest import SMALL
from oracle import duck, same

from braidwork.llm import catalog


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_same_as_sql(spark, name):
    assert same(catalog.QUERIES[name](spark, SMALL), catalog.ORACLES[name], duck(SMALL)) == ""


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_a_row_per_document(spark, name):
    """Or 32 for each of the 500 vectors."""
    assert catalog.QUERIES[name](spark, SMALL).count() == (32 * 500 if name == "op13_whitening" else 200)
