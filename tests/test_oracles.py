import pytest

from docstrata.plans import catalog
from tests.oracle import assert_equal


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert_equal(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    n = catalog.QUERIES[name](spark, sf).count()
    assert n > 0 or name == "html_tables"  # the pages given hold no table
