"""Every registered query against its SQL at the smallest scale."""

import pytest

from shotloom import catalog

from .compare import compare, connect

PATH = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare(spark, con, PATH, name, catalog.queries()[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_rows_only(spark, name):
    assert catalog.queries()[name](spark, PATH).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
