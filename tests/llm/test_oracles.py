import pytest

from docstrata.llm import registry
from tests.oracle import assert_equal


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert_equal(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], sf)
