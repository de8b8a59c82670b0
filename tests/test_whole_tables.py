"""The queries over whole tables: their size follows the tables, and they equal their SQL at sf0.01."""

import pytest

from docstrata.operators import corpus as co
from docstrata.plans import catalog
from tests.oracle import assert_equal

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["link_frontier_all_orders", "bfs_depth3_all_orders"])
def test_links_of_every_order(spark, sf, name):
    assert_equal(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)
    small, large = (catalog.QUERIES[name](spark, d).count() for d in (sf, SF))
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert 0 < 5 * small < large < orders
    if name.startswith("bfs"):
        assert {r.depth for r in catalog.QUERIES[name](spark, SF).select("depth").distinct().collect()} == {0, 1, 2, 3}


def test_frontier_takes_fifty_links_a_page(spark):
    links = spark.range(61).selectExpr("1L as src", "id as dst")
    got = co.frontier(links, links.where("dst = 3").select("dst"), ["dst"])
    assert sorted(r.dst for r in got.collect()) == [n for n in range(51) if n != 3]


def test_every_url_is_decided(spark):
    name = "sitemap_diff_all_orders"
    assert_equal(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)
    take = {r["take"]: r["count"] for r in catalog.QUERIES[name](spark, SF).groupBy("take").count().collect()}
    assert sum(take.values()) == spark.read.parquet(f"{SF}/orders.parquet").count() and min(take.values()) > 0 and len(take) == 2


def test_chunks_meet_more_than_200_documents(spark):
    for name in sorted(n for n in catalog.QUERIES if n.endswith("_all_docs")):
        assert_equal(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)
    chunks = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert catalog.QUERIES["chunk_stats_by_doc_all_docs"](spark, SF).count() == chunks > 200
