"""Views of the benchmark tables in the roles of the corpus schema, in Spark SQL and DuckDB alike.

"now" is a literal, so results do not depend on when a query runs.
"""

from __future__ import annotations

import re

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
VIEWS = {
    "kb_documents": "SELECT doc_id AS id, text AS content, source AS folder_id, lang AS language, CASE WHEN doc_id % 3 = 0 THEN 'gov_crawled' ELSE 'user_created' END AS document_type, doc_id % 7 AS user_id FROM documents",
    "chunks": "SELECT vec_id AS chunk_id, vec_id % 200 AS document_id, vec_id AS chunk_index, embedding, label FROM embeddings",
    "chunks_by_doc": "SELECT vec_id AS chunk_id, vec_id % (SELECT count(*) FROM documents) AS document_id, vec_id AS chunk_index, embedding, label FROM embeddings",
    "two_vectors": "SELECT vec_id AS chunk_id, vec_id % (SELECT count(*) FROM documents) AS document_id, slice(embedding, 1, 16) AS embedding, CASE WHEN vec_id % 9 <> 0 THEN embedding END AS embedding_large, CASE WHEN vec_id % 7 <> 0 THEN label END AS embedding_small, label AS token_count FROM embeddings",
    "text_chunks": "SELECT doc_id AS chunk_id, doc_id AS document_id, text AS chunk_text, source AS section_heading, embedding FROM documents JOIN embeddings ON doc_id = vec_id",
    "metrics": "SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'success' END AS status, value * 10 AS duration_ms, user_id AS source_id, event_id % 9 AS chunks_created FROM events",
    "queue": "SELECT event_id AS id, user_id AS document_id, CAST(ts AS TIMESTAMP) AS created_at, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'completed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'processing' ELSE 'failed' END AS status, CASE user_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END AS priority, CAST(user_id % 4 AS INT) AS attempts, CASE WHEN event_type IN ('view', 'purchase') AND user_id % 11 <> 0 THEN CAST(ts AS TIMESTAMP) END AS processed_at, CASE user_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'E5 API error (502)' WHEN 2 THEN 'fetch failed' ELSE 'bad input' END AS message FROM events",
    "sources": "SELECT c_custkey AS source_id, c_name AS name, c_mktsegment AS kind, c_custkey % 4 <> 0 AS is_active FROM customer",
    "crawl_pages": "SELECT o_orderkey AS page_id, o_custkey AS source_id, o_orderstatus AS status, CAST(o_orderdate AS TIMESTAMP) AS crawled_at, o_totalprice AS size FROM orders",
    "plans": "SELECT c_custkey AS user_id, CAST(c_custkey % 120 AS INT) AS messages_used, 100 AS messages_limit, c_custkey % 1000 AS tokens_used, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE TIMESTAMP '2024-02-15 00:00:00' END AS cycle_end FROM customer WHERE c_custkey % 5 <> 0",
}


TABLES = ("documents", "embeddings", "events", "customer", "orders", "pages", "conversations", "benchmark", "labels", "nation", "region", "lineitem", "part", "supplier")


def named(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def register(spark, sf_dir: str, *sqls: str) -> None:
    """Temporary views of the tables and roles that the statements name."""
    roles = named(" ".join(sqls), VIEWS)
    for t in named(" ".join([*sqls, *(VIEWS[r] for r in roles)]), TABLES):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for r in roles:
        spark.sql(VIEWS[r]).createOrReplaceTempView(r)


def duck(sql: str, *names: str) -> str:
    """DuckDB SQL over the roles it names."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].replace('slice(', 'list_slice(')})" for n in names) + " " + sql
