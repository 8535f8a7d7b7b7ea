"""Every registered query of the package against its SQL."""

import pytest

from quillgrid.plans import catalog
from tests.compare import check_against_duckdb


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, name):
    check_against_duckdb(spark, catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
