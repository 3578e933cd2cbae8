"""Every registered query runs; those with SQL agree with DuckDB on the same tables."""

import pytest

from tests.compare import assert_same, duck, rows_of
from vectide import catalog

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.seconds(300)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = rows_of(catalog.QUERIES[name](spark, SF))
    assert got[1]
    if name in catalog.ORACLE_SQL:
        assert_same(got, duck(SF, catalog.ORACLE_SQL[name]))


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
