"""Queries of the core operators, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, text as tx
from ..operators import corpus as co
from ..operators import monitoring as mo
from ..operators import search as se
from ..sources import readers
from ..streaming import jobs
from ..tables import cut
from .adapters import NOW, VIEWS, duck, register

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name in VIEWS:
        register(spark, sf, VIEWS[name])
        return spark.sql(VIEWS[name])
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, *tables: str, sql: str | None = None, roles: tuple[str, ...] | None = None):
    """Register build(*tables) under name; sql is its equal, roles the views it names (those of tables if not given)."""

    def add(build):
        QUERIES[name] = lambda spark, sf: build(*(_t(spark, sf, t) for t in tables))
        if sql:
            used = roles if roles is not None else tuple(t for t in tables if t in VIEWS)
            ORACLE_SQL[name] = duck(sql, *used) if used else sql
        return build

    return add


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


_COS = "list_sum(list_transform(list_zip(c.embedding::DOUBLE[], q.e::DOUBLE[]), lambda p: p[1] * p[2]))"
_SIM = f"({_COS} / (sqrt(list_sum(list_transform(c.embedding::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform(q.e::DOUBLE[], lambda x: x * x)))))"


def _one(chunks: DataFrame, i: int = 1) -> DataFrame:
    return chunks.where(F.col("chunk_id") == i).select(F.col("embedding").alias("q"))


def _vector(where: str, threshold: float, k: int, i: int = 1) -> str:
    return f"SELECT c.chunk_id, c.document_id, round({_SIM}, 6) AS similarity FROM chunks c JOIN kb_documents d ON d.id = c.document_id, (SELECT embedding AS e FROM chunks WHERE chunk_id = {i}) q WHERE {where} AND {_SIM} > {threshold} ORDER BY {_SIM} DESC, c.chunk_id LIMIT {k}"


def _rounded(df: DataFrame, col: str = "similarity") -> DataFrame:
    return df.withColumn(col, F.round(col, 6))


@query("vector_topk_small", "chunks", "kb_documents", sql=_vector("true", 0.1, 10))
def _(c, d):
    return _rounded(se.vector_search(c, d, _one(c), 0.1, 10, when_null="all"))


@query("vector_topk_coarse_visibility", "chunks", "kb_documents", sql=_vector("d.document_type = 'gov_crawled'", 0.05, 20))
def _(c, d):
    return _rounded(se.vector_search(c, d, _one(c), 0.05, 20))


@query("vector_topk_user_folders", "chunks", "kb_documents", sql=_vector("(d.document_type = 'gov_crawled' OR d.user_id = 3) AND d.folder_id IN ('src0', 'src1')", 0.0, 20))
def _(c, d):
    return _rounded(se.vector_search(c, d, _one(c), 0.0, 20, 3, ["src0", "src1"]))


def _cos(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}::DOUBLE[], {y}::DOUBLE[]), lambda p: p[1] * p[2]))"
    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


@query("vector_rerank_two_stage", "two_vectors", "kb_documents", sql=f"SELECT chunk_id, document_id, round(coarse, 6) AS coarse, round({_cos('embedding_large', 'q.e')}, 6) AS similarity FROM (SELECT c.*, {_cos('c.embedding', 'q.e')} AS coarse FROM two_vectors c, (SELECT embedding AS e FROM two_vectors WHERE chunk_id = 2) q WHERE document_id IN (SELECT id FROM kb_documents) ORDER BY coarse DESC, chunk_id LIMIT 50), (SELECT embedding_large AS e FROM two_vectors WHERE chunk_id = 2) q WHERE embedding_large IS NOT NULL ORDER BY {_cos('embedding_large', 'q.e')} DESC, chunk_id LIMIT 5")
def _(c, d):
    one = c.where("chunk_id = 2")
    return _rounded(_rounded(se.two_stage(c, d, one.select("embedding"), one.select("embedding_large"), 50, 5, when_null="all")), "coarse")


@query("cosine_pairs", "chunks", sql=f"SELECT c.chunk_id, round({_SIM}, 6) AS similarity FROM chunks c, (SELECT embedding AS e FROM chunks WHERE chunk_id = 0) q")
def _(c):
    return c.crossJoin(F.broadcast(_one(c, 0))).select("chunk_id", F.round(se.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


def _bm25(words: list[str], match: str, k: int, docs: str = "kb_documents", ident: str = "id") -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{n}" for n, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{n} > 0) AS df{n}" for n in range(len(words)))
    s = " + ".join(f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in range(len(words)))
    cond = (" AND " if match == "all" else " OR ").join(f"tf{i} > 0" for i in range(len(words)))
    return f", tk AS (SELECT {ident} AS id, list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM {docs}), ct AS (SELECT id, len(t) AS dl, {tf} FROM tk), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM ct), kw AS (SELECT id, {s} AS bm25_score FROM ct, st WHERE {cond} ORDER BY bm25_score DESC, id LIMIT {k})"


def _kw(words, match, k):
    return (duck("", "kb_documents") + _bm25(words, match, k)).replace("  ,", " ,")


QUERIES["bm25_all_terms"] = lambda s, sf: _rounded(se.bm25(_t(s, sf, "kb_documents"), "the and of", 20), "bm25_score")
ORACLE_SQL["bm25_all_terms"] = _kw(["and", "of", "the"], "all", 20) + " SELECT id, round(bm25_score, 6) AS bm25_score FROM kw"
QUERIES["bm25_any_term"] = lambda s, sf: _rounded(se.bm25(_t(s, sf, "kb_documents"), "licensed apache stupid", 20, "any"), "bm25_score")
ORACLE_SQL["bm25_any_term"] = _kw(["apache", "licensed", "stupid"], "any", 20) + " SELECT id, round(bm25_score, 6) AS bm25_score FROM kw"


def _hybrid(spark, sf, query_text, wv, wb):
    c, d = _t(spark, sf, "chunks"), _t(spark, sf, "kb_documents")
    v = se.vector_search(c, d, _one(c), 0.0, 20, when_null="all").select(F.col("chunk_id").alias("id"), "similarity")
    out = se.hybrid(v, se.bm25(d, query_text, 20), wv, wb, 10)
    return out.select("id", *[F.round(x, 6).alias(x) for x in ("vector_score", "bm25_score", "hybrid_score")])


def _hybrid_sql(words, wv, wb):
    vec = _vector("true", 0.0, 20).replace(f"round({_SIM}, 6)", _SIM)
    return duck("", "kb_documents", "chunks") + _bm25(words, "all", 20) + f", vv AS (SELECT chunk_id AS id, similarity FROM ({vec})), hh AS (SELECT coalesce(vv.id, kw.id) AS id, coalesce(similarity, 0) AS v, coalesce(bm25_score, 0) AS b FROM vv FULL OUTER JOIN kw ON vv.id = kw.id) SELECT id, round(v, 6) AS vector_score, round(b, 6) AS bm25_score, round({wv}::DOUBLE * v + {wb}::DOUBLE * b, 6) AS hybrid_score FROM hh ORDER BY {wv}::DOUBLE * v + {wb}::DOUBLE * b DESC, id LIMIT 10"


QUERIES["hybrid_weighted"] = lambda s, sf: _hybrid(s, sf, "the and of", 0.7, 0.3)
ORACLE_SQL["hybrid_weighted"] = _hybrid_sql(["and", "of", "the"], 0.7, 0.3)
QUERIES["hybrid_smart"] = lambda s, sf: _hybrid(s, sf, "version 2", 0.4, 0.6)
ORACLE_SQL["hybrid_smart"] = _hybrid_sql(["2", "version"], 0.4, 0.6)


@query("query_kind_weights", "benchmark", sql="SELECT item_id, CASE WHEN x THEN 0.4 ELSE 0.7 END::DOUBLE AS vector_weight, CASE WHEN x THEN 'keyword_boosted' ELSE 'semantic_primary' END AS search_strategy FROM (SELECT item_id, regexp_matches(text, '\\d') OR regexp_matches(text, '\\b[A-Z]{3,}\\b') OR regexp_matches(text, '\"[^\"]+\"') AS x FROM benchmark)")
def _(b):
    w = se.query_weights(F.col("text"))
    return b.select("item_id", w["vector_weight"].cast("double").alias("vector_weight"), w["search_strategy"].alias("search_strategy"))


@query("chunk_stats_by_doc", "chunks", sql="SELECT document_id, count(*) AS chunk_count, count(embedding) AS embedded, round(avg(chunk_index), 6) AS avg_index FROM chunks GROUP BY 1")
def _(c):
    return mo.chunk_stats(c)


def _all_docs(name: str, build, sql: str, *tables: str) -> None:
    """A query of chunks again over chunks dealt to all documents."""
    query(f"{name}_all_docs", "chunks_by_doc", *tables, sql=sql.replace("chunks", "chunks_by_doc"))(build)


_all_docs("vector_topk_small", lambda c, d: _rounded(se.vector_search(c, d, _one(c), 0.1, 10, when_null="all")), _vector("true", 0.1, 10), "kb_documents")
_all_docs("vector_topk_coarse_visibility", lambda c, d: _rounded(se.vector_search(c, d, _one(c), 0.05, 20)), _vector("d.document_type = 'gov_crawled'", 0.05, 20), "kb_documents")
_all_docs("vector_topk_user_folders", lambda c, d: _rounded(se.vector_search(c, d, _one(c), 0.0, 20, 3, ["src0", "src1"])), _vector("(d.document_type = 'gov_crawled' OR d.user_id = 3) AND d.folder_id IN ('src0', 'src1')", 0.0, 20), "kb_documents")
_all_docs("chunk_stats_by_doc", mo.chunk_stats, "SELECT document_id, count(*) AS chunk_count, count(embedding) AS embedded, round(avg(chunk_index), 6) AS avg_index FROM chunks GROUP BY 1")


_CACHE = "SELECT c_nationkey * 10 + c_custkey % 7 AS query_key, count(*) AS hit_count, max(c_custkey) AS last_used FROM customer GROUP BY 1"


def _cache(customer):
    return customer.groupBy((F.col("c_nationkey") * 10 + F.col("c_custkey") % 7).alias("query_key")).agg(F.count(F.lit(1)).alias("hit_count"), F.max("c_custkey").alias("last_used"))


@query("cache_stats", "customer", sql=f"SELECT count(*) AS total, CAST(sum(hit_count) AS BIGINT) AS hits, round(avg(hit_count), 6) AS avg_hits, count(*) FILTER (hit_count > 1) AS reused, round(100.0::DOUBLE * (count(*) FILTER (hit_count > 1)) / nullif(count(*), 0), 2) AS reuse_rate FROM ({_CACHE})")
def _(c):
    return mo.cache_stats(_cache(c))


@query("popular_queries", "customer", sql=f"SELECT * FROM ({_CACHE}) WHERE hit_count > 1 ORDER BY hit_count DESC, last_used DESC, query_key LIMIT 100")
def _(c):
    return mo.popular(_cache(c))


@query("queue_stats_recent", "queue", sql=f"SELECT status, count(*) AS n FROM queue WHERE status <> 'completed' OR processed_at > {NOW} - INTERVAL 1 DAY GROUP BY 1")
def _(q):
    return mo.queue_stats(q, now())


@query("queue_stats_pivot", "queue", sql="SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'failed') AS failed, CAST(0 AS BIGINT) AS completed, count(*) AS total FROM queue WHERE status <> 'completed'")
def _(q):
    return mo.queue_pivot(q)


@query("queue_head_text_priority", "queue", sql="SELECT id, priority FROM queue WHERE status = 'pending' ORDER BY priority DESC, created_at, id LIMIT 80")
def _(q):
    return co.queue_head(q, 80).select("id", "priority")


@query("queue_head_semantic_priority", "queue", sql="SELECT id, priority FROM queue WHERE status = 'pending' ORDER BY CASE priority WHEN 'high' THEN 2 WHEN 'normal' THEN 1 ELSE 0 END DESC, created_at, id LIMIT 80")
def _(q):
    return co.queue_head(q, 80, True).select("id", "priority")


@query("queue_transition", "queue", sql="SELECT id, CASE WHEN r THEN 'pending' ELSE 'failed' END AS status, CASE WHEN r THEN attempts + 1 ELSE attempts END AS attempts FROM (SELECT *, regexp_matches(message, '(?i)timeout|502|503|fetch') AND attempts + 1 < 3 AS r FROM queue)")
def _(q):
    return q.select("id", co.after_failure(F.col("message"), F.col("attempts")).alias("s")).select("id", "s.*")


@query("queue_cleanup_count", "queue", sql=f"SELECT count(*) AS removed FROM queue WHERE status = 'completed' AND processed_at < {NOW} - INTERVAL 7 DAYS")
def _(q):
    return co.cleanup(q, now(), 7)[1]


@query("crawler_stats_24h", "metrics", sql="SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, printf('%.1f%%', 100.0 * (count(*) FILTER (status = 'success')) / count(*)) AS success_rate, printf('%.1f%%', 100.0 * (count(*) FILTER (status = 'failed')) / count(*)) AS failure_rate, CAST(round(sum(duration_ms) / count(*)) AS BIGINT) AS avg_ms, CAST(sum(chunks_created) AS BIGINT) AS chunks FROM metrics WHERE ts >= TIMESTAMP '2024-01-30 00:00:00'")
def _(m):
    return mo.crawler_stats(m, now() - F.expr("INTERVAL 24 HOURS"))


@query("recent_failure_alert", "metrics", sql="SELECT round(coalesce((count(*) FILTER (status = 'failed')) / nullif(count(*), 0), 0), 6) AS failure_rate, coalesce((count(*) FILTER (status = 'failed')) / nullif(count(*), 0), 0) > 0.2 AS alert FROM metrics WHERE ts >= TIMESTAMP '2024-01-30 23:00:00'")
def _(m):
    return mo.failure_rate(m, now() - F.expr("INTERVAL 1 HOUR"))


@query("trailing_hour_failure_rate", "metrics", sql="SELECT id, source_id, round((sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER w) / (count(*) OVER w), 6) AS rate FROM metrics WINDOW w AS (PARTITION BY source_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)")
def _(m):
    return mo.trailing_failure_rate(m)


@query("daily_crawl_stats", "metrics", sql="SELECT CAST(day AS VARCHAR) AS day, total, success, failed, skipped, duration_ms, chunks FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, round(sum(duration_ms), 2) AS duration_ms, CAST(sum(chunks_created) AS BIGINT) AS chunks FROM metrics GROUP BY 1 ORDER BY 1 DESC LIMIT 7) ORDER BY day")
def _(m):
    return mo.daily_stats(m).withColumn("day", F.col("day").cast("string"))


@query("dashboard_kpis", "sources", "crawl_pages", "metrics", sql="SELECT (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FILTER (is_active) FROM sources) AS active_sources, (SELECT count(*) FROM crawl_pages) AS pages, count(*) AS crawls, round(100.0::DOUBLE * (count(*) FILTER (status = 'success')) / count(*), 1) AS success_rate, CAST(sum(chunks_created) AS BIGINT) AS chunks, CAST(round(sum(duration_ms) / count(*)) AS BIGINT) AS avg_ms, count(*) FILTER (status = 'failed') AS failed, round(100.0::DOUBLE * (count(*) FILTER (status = 'failed')) / count(*), 1) AS failed_rate FROM metrics WHERE ts >= TIMESTAMP '2024-01-30 00:00:00'")
def _(s, p, m):
    return mo.dashboard(s, p, m, now() - F.expr("INTERVAL 24 HOURS"))


@query("sources_page_counts", "sources", "crawl_pages", sql="SELECT source_id, name, coalesce(n, 0) AS pages FROM sources LEFT JOIN (SELECT source_id, count(*) AS n FROM crawl_pages GROUP BY 1) USING (source_id)")
def _(s, p):
    return mo.page_counts(s, p)


@query("pages_with_source", "crawl_pages", "sources", sql="SELECT page_id, status, name FROM crawl_pages LEFT JOIN sources USING (source_id)")
def _(p, s):
    return p.join(s, "source_id", "left").select("page_id", "status", "name")


@query("recent_activity", "crawl_pages", sql="SELECT page_id, CAST(CAST(crawled_at AS DATE) AS VARCHAR) AS day FROM crawl_pages ORDER BY crawled_at DESC NULLS FIRST, page_id LIMIT 50")
def _(p):
    return mo.recent(p, "crawled_at", "page_id", 50).select("page_id", F.to_date("crawled_at").cast("string").alias("day"))


@query("offset_page", "crawl_pages", sql="SELECT page_id, CAST(CAST(crawled_at AS DATE) AS VARCHAR) AS day FROM crawl_pages ORDER BY crawled_at DESC, page_id LIMIT 5 OFFSET 10")
def _(p):
    return mo.page_of(p, [F.desc("crawled_at"), "page_id"], 10, 5).select("page_id", F.to_date("crawled_at").cast("string").alias("day"))


_ENTRIES = "SELECT 'u' || (o_orderkey % 5000) AS url, max(CAST(o_orderdate AS TIMESTAMP)) AS lastmod FROM orders GROUP BY 1"
_PAGES = "SELECT 'u' || o_orderkey AS url, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'success' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS sitemap_lastmod, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2024-01-30 12:00:00' ELSE TIMESTAMP '2024-01-28 00:00:00' END AS last_crawled_at FROM orders WHERE o_orderkey % 4 <> 1"


def _sql(name: str, sql: str, spark_sql: Callable):
    QUERIES[name] = spark_sql
    ORACLE_SQL[name] = sql


_sql("sitemap_diff", f"SELECT url, CASE WHEN status IS NULL THEN true WHEN status = 'failed' THEN last_crawled_at <= {NOW} - INTERVAL 24 HOURS WHEN lastmod IS NOT NULL AND sitemap_lastmod IS NOT NULL THEN lastmod > sitemap_lastmod ELSE true END AS take FROM ({_ENTRIES}) LEFT JOIN ({_PAGES}) USING (url)", lambda s, sf: (register(s, sf, _ENTRIES), co.sitemap_diff(s.sql(_ENTRIES), s.sql(_PAGES), now()))[1])

# The same over every order; a url's entries are the dates of its order and of the order's lines.
_ALL_ENTRIES = "SELECT url, max(day) AS lastmod FROM (SELECT 'u' || o_orderkey AS url, CAST(o_orderdate AS TIMESTAMP) AS day FROM orders UNION ALL SELECT 'u' || l_orderkey, CAST(l_shipdate AS TIMESTAMP) FROM lineitem) GROUP BY 1"
_sql("sitemap_diff_all_orders", ORACLE_SQL["sitemap_diff"].replace(_ENTRIES, _ALL_ENTRIES), lambda s, sf: (register(s, sf, _ALL_ENTRIES), co.sitemap_diff(s.sql(_ALL_ENTRIES), s.sql(_PAGES), now()))[1])


@query("expired_url_filter", "pages", sql=f"SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '{tx.EXPIRED}')")
def _(p):
    return p.where(~tx.expired_path(F.col("url"))).select("page_id", "url")


# Customer pages link to the pages of their orders, whose numbers are page numbers too.
_ALL_EDGES = "SELECT o_custkey AS src, o_orderkey AS dst FROM orders"
_CRAWLED = "SELECT o_orderkey AS dst FROM orders WHERE o_orderstatus = 'F'"
_SEEDS = "SELECT c_custkey AS node FROM customer WHERE c_nationkey = 1"
_sql("link_frontier_all_orders", f"SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM (SELECT DISTINCT src, dst FROM ({_ALL_EDGES})) WHERE dst NOT IN ({_CRAWLED})) WHERE rn <= 50", lambda s, sf: (register(s, sf, _ALL_EDGES), co.frontier(s.sql(_ALL_EDGES), s.sql(_CRAWLED), ["dst"]).select("src", "dst"))[1])
_sql("bfs_depth3_all_orders", f"WITH RECURSIVE e AS ({_ALL_EDGES}), r(node, depth) AS (SELECT node, 0 FROM ({_SEEDS}) UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY 1", lambda s, sf: (register(s, sf, _ALL_EDGES, _SEEDS), co.bfs(s.sql(_ALL_EDGES), s.sql(_SEEDS)))[1])


@query("domain_rate_schedule", "crawl_pages", sql="SELECT page_id, CAST(floor((row_number() OVER (PARTITION BY source_id ORDER BY crawled_at, page_id) - 1) / 5) * 60 AS BIGINT) AS start_s FROM crawl_pages")
def _(p):
    return co.schedule(p, "source_id", "crawled_at", "page_id").select("page_id", "start_s")


@query("url_slice_50", "pages", sql="SELECT page_id, url FROM (SELECT *, row_number() OVER (ORDER BY url, page_id) AS rn FROM pages) WHERE rn > 50 AND rn <= 100")
def _(p):
    return mo.page_of(p, ["url", "page_id"], 50, 50).select("page_id", "url")


@query("rls_documents", "kb_documents", sql="SELECT id FROM kb_documents WHERE document_type = 'gov_crawled' OR user_id = 2")
def _(d):
    return se.secure_view(d, 2).select("id")


@query("rls_messages_semi", "conversations", "sources", sql="SELECT conv_id, turn FROM conversations m WHERE EXISTS (SELECT 1 FROM sources s WHERE s.source_id = m.conv_id AND s.source_id % 7 = 3)")
def _(m, s):
    own = s.select(F.col("source_id").alias("conv"), (F.col("source_id") % 7).alias("user_id"))
    return co.child_view(m, own, "conv_id", "conv", 3).select("conv_id", "turn")


@query("users_without_plan", "sources", "plans", sql="SELECT source_id AS user_id FROM sources WHERE source_id NOT IN (SELECT user_id FROM plans)")
def _(s, p):
    return co.without_plan(s.select(F.col("source_id").alias("user_id")), p)


_USE = f"SELECT user_id, CAST(CASE WHEN cycle_end < {NOW} THEN 0 ELSE messages_used END AS INT) AS messages_used, CASE WHEN cycle_end < {NOW} THEN {NOW} + INTERVAL 30 DAYS ELSE cycle_end END AS cycle_end, CASE WHEN cycle_end < {NOW} THEN 0 ELSE messages_used END < messages_limit AS can_send FROM plans"


@query("usage_cycle_reset", "plans", sql=f"SELECT user_id, messages_used, CAST(CAST(cycle_end AS DATE) AS VARCHAR) AS cycle_end FROM ({_USE})")
def _(p):
    return co.usage(p, now()).select("user_id", "messages_used", F.to_date("cycle_end").cast("string").alias("cycle_end"))


@query("can_send_message", "plans", sql=f"SELECT user_id, can_send FROM ({_USE})")
def _(p):
    return co.usage(p, now()).select("user_id", "can_send")


@query("trust_levels", "kb_documents", sql="SELECT id, CAST(CASE WHEN document_type = 'gov_crawled' THEN 1.00 ELSE 0.70 END AS DOUBLE) AS trust_level FROM kb_documents")
def _(d):
    return d.select("id", co.trust_level(F.col("document_type")).cast("double").alias("trust_level"))


@query("constraint_audit", "conversations", sql="SELECT 'role' AS rule, count(*) FILTER (NOT coalesce(role IN ('user', 'assistant', 'system'), false)) AS violations FROM conversations UNION ALL SELECT 'content', count(*) FILTER (NOT coalesce(length(text) > 20, false)) FROM conversations")
def _(c):
    return co.audit(c, {"role": F.col("role").isin("user", "assistant", "system"), "content": F.length("text") > 20})


_STALE = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS updated_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE TIMESTAMP '1996-01-01 00:00:00' END AS embedded_at FROM orders"
_sql("stale_documents", f"SELECT id FROM ({_STALE}) WHERE embedded_at IS NULL OR (updated_at IS NOT NULL AND updated_at > embedded_at)", lambda s, sf: (register(s, sf, _STALE), s.sql(_STALE).where(co.stale(F.col("updated_at"), F.col("embedded_at"))).select("id"))[1])


@query("content_hash_changed", "documents", "kb_documents", sql="SELECT d.doc_id, sha256(text) AS content_hash, sha256(text) <> sha256(CASE WHEN doc_id % 4 = 0 THEN text || '.' ELSE text END) AS changed FROM documents d", roles=())
def _(d, k):
    old = k.select(F.col("id").alias("doc_id"), F.sha2(F.when(F.col("id") % 4 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content")), 256).alias("old"))
    return d.join(old, "doc_id", "left").select("doc_id", F.sha2("text", 256).alias("content_hash"), (F.sha2("text", 256) != F.col("old")).alias("changed"))


_NEW = "SELECT o_custkey AS document_id, o_orderkey % 10 AS chunk_index, max(o_orderkey % 7) AS chunk_hash FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2"
_OLD = "SELECT o_custkey AS document_id, o_orderkey % 10 AS chunk_index, max(o_orderkey % 7) AS chunk_hash FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1, 2"
_ACT = f"SELECT document_id, chunk_index, CASE WHEN o.chunk_hash IS NULL THEN 'insert' WHEN n.chunk_hash IS NULL THEN 'delete' WHEN n.chunk_hash = o.chunk_hash THEN 'keep' ELSE 'update' END AS action FROM ({_NEW}) n FULL OUTER JOIN ({_OLD}) o USING (document_id, chunk_index)"
_sync = lambda s, sf: (register(s, sf, _NEW), co.sync_actions(s.sql(_NEW), s.sql(_OLD), ["document_id", "chunk_index"]))[1]
_sql("chunk_sync_actions", _ACT, _sync)
_sql("chunk_sync_counts", f"SELECT action, count(*) AS n FROM ({_ACT}) GROUP BY 1", lambda s, sf: _sync(s, sf).groupBy("action").agg(F.count(F.lit(1)).alias("n")))


@query("upsert_latest", "orders", sql="SELECT o_custkey AS key, max(o_orderkey) AS version FROM orders GROUP BY 1")
def _(o):
    rows = o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"))
    return co.upsert(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), ["key"], "version")


def _text(name: str, build, sql: str) -> None:
    query(name, "documents", sql=f"SELECT doc_id, {sql} FROM documents")(lambda d: d.select("doc_id", *build(F.col("text"))))


def _like(words) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


def _case(table, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{n.replace(chr(39), chr(39) * 2)}'" for n, p in table) + f" ELSE '{default}' END"


def _listed(pairs, default: str | None = None) -> str:
    array = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], lambda x: x IS NOT NULL)"
    return f"array_to_string({array}, ',')" if default is None else f"coalesce(nullif(array_to_string({array}, ','), ''), '{default}')"


_joined = lambda c, n: F.array_join(c, ",").alias(n)
_text("truncate_validate", lambda t: [F.length(tx.truncate(t, 300)).cast("long").alias("kept"), tx.content_valid(t, F.lit("title")).alias("valid"), F.round(tx.truncation(t, 300)["ratio"], 6).alias("ratio")], "length(CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 300) || chr(10) || chr(10) || '[Content truncated due to size limits]' END) AS kept, length(text) >= 100 AS valid, round(CASE WHEN length(text) = 0 THEN 1 ELSE least(length(text), 300) / length(text) END, 6) AS ratio")
_text("token_estimates", lambda t: [tx.token_estimate(t, 4).alias("by4"), tx.token_estimate(t, 3.5).alias("by35"), tx.word_count(t).cast("long").alias("words")], "CAST(ceil(length(text) / 4.0::DOUBLE) AS BIGINT) AS by4, CAST(ceil(length(text) / 3.5::DOUBLE) AS BIGINT) AS by35, len(string_split_regex(text, '\\s+')) AS words")
_text("language_detect", lambda t: [tx.detect_language(t).alias("language")], "CASE WHEN " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in tx.MALAY) + " > " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in tx.ENGLISH) + " THEN 'ms' ELSE 'en' END AS language")
_text("page_type", lambda t: [tx.page_type(F.lit(""), t).alias("page_type")], "CASE " + " ".join(f"WHEN {_like(w)} THEN '{n}'" for n, w in tx.PAGE_TYPES) + " ELSE 'general' END AS page_type")
_text("topic_keywords", lambda t: [_joined(tx.topic_keywords(t), "topics")], _listed([(n, _like(w)) for n, w in tx.TOPICS.items()]) + " AS topics")
_text("service_topics", lambda t: [_joined(tx.service_topics(t), "topics")], _listed([(n, _like(w)) for n, w in tx.SERVICE_TOPICS.items()]) + " AS topics")
_text("document_type", lambda t: [tx.document_type(t).alias("document_type")], _case(tx.DOCUMENT_TYPES, "guide") + " AS document_type")
_text("content_category", lambda t: [tx.content_category(t).alias("category")], _case(tx.CATEGORIES[::-1], "contact") + " AS category")
_text("ministry_audience", lambda t: [tx.ministry(t).alias("ministry"), _joined(tx.audience(t), "audience")], _case(tx.MINISTRIES, "Unknown Ministry") + " AS ministry, " + _listed([(n, f"regexp_matches(text, '(?i){p}')") for n, p in tx.AUDIENCES], "Citizens") + " AS audience")
_ENDING = " Updated 3/4/2021 at 12A, Jalan Besar, 50480 Kuala Lumpur by the Ministry of Health. Fee RM 1,200.50, IC 880101-14-5678, effective 1 Mac 2022 until 31.12.2023? Application Process and Policy program. "
_FACTS = f"(text || '{_ENDING}')"
_SQL_DATE = r"(?i)\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}|\d{1,2}\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|Januari|Februari|Mac|April|Mei|Jun|Julai|Ogos|September|Oktober|November|Disember)\s+\d{2,4}"


def _facts(name: str, build, sql: str) -> None:
    """A text query over documents that end in a few facts of each kind."""
    _text(name, lambda t: build(F.concat(t, F.lit(_ENDING))), sql.replace("TEXT", _FACTS))


_facts("entities", lambda t: [_joined(tx.entities(t), "entities")], "array_to_string(list_concat(" + ", ".join(f"list_transform(regexp_extract_all(TEXT, '{p}'), lambda m: '{k}:' || m)" for k, p in {"ic_number": r"\d{6}-\d{2}-\d{4}", "phone": r"0\d{1,2}-\d{7,8}|\+60\d{1,2}-\d{7,8}", "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "dates": _SQL_DATE, "money": r"(?i)RM\s*\d+(?:,\d{3})*(?:\.\d{2})?|\d+(?:,\d{3})*(?:\.\d{2})?\s*ringgit", "addresses": r"\d+[A-Za-z]?,?\s+[A-Za-z\s]+,\s+\d{5}\s+[A-Za-z\s]+"}.items()) + "), ',') AS entities")
_facts("keywords", lambda t: [_joined(F.array_sort(tx.keywords(t)), "keywords")], "array_to_string(list_sort(list_distinct(list_transform(list_concat(list_slice(regexp_extract_all(TEXT, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){1,2}\\b'), 1, 10), regexp_extract_all(TEXT, '(?i)\\b(?:ministry|kementerian|department|jabatan|policy|dasar|program|bantuan|assistance|application|permohonan)\\b')), lambda k: lower(k)))), ',') AS keywords")
_NEAR = "substr(TEXT, greatest(instr(TEXT, d) - 50, 1), length(d) + 50 + least(instr(TEXT, d) - 1, 50))"
_facts("date_roles", lambda t: [tx.date_roles(t)[n].alias(n) for n, _ in tx.DATE_ROLES], ", ".join(f"list_filter(regexp_extract_all(TEXT, '{_SQL_DATE}'), lambda d: {c})[-1] AS {n}" for n, c in (("effective_date", f"regexp_matches({_NEAR}, '(?i)effective|berkuat kuasa|mula')"), ("expiry_date", f"NOT regexp_matches({_NEAR}, '(?i)effective|berkuat kuasa|mula') AND regexp_matches({_NEAR}, '(?i)expir|tamat|until|hingga')"), ("last_updated", f"NOT regexp_matches({_NEAR}, '(?i)effective|berkuat kuasa|mula|expir|tamat|until|hingga') AND regexp_matches({_NEAR}, '(?i)updated|dikemaskini|last')"))))
_facts("fee_context", lambda t: [F.md5(tx.fee_context(t)).alias("digest")], "CASE WHEN f <> '' THEN md5(regexp_replace(substr(TEXT, greatest(instr(TEXT, f) - 100, 1), 100 + least(instr(TEXT, f) - 1, 100)), '^\\s+|\\s+$', '', 'g')) END AS digest")
ORACLE_SQL["fee_context"] = ORACLE_SQL["fee_context"].replace("FROM documents", f"FROM (SELECT *, regexp_extract({_FACTS}, '(?i)(RM|MYR)\\s*([0-9,]+(\\.[0-9]{{2}})?)', 0) AS f FROM documents)")
_facts("program_department", lambda t: [tx.program_name(t).alias("program"), tx.department(F.concat(F.lit("Unit "), F.substring(t, 1, 9))).alias("department"), tx.department(F.substring(t, 1, 4)).alias("short")], "coalesce(" + ", ".join(f"nullif(regexp_replace(regexp_extract(TEXT, '(?i){w}\\s+([A-Z][A-Za-z\\s]+)', 1), '^\\s+|\\s+$', '', 'g'), '')" for w in ("program", "bantuan", "scheme", "skim")) + ") AS program, 'Unit ' || substr(TEXT, 1, 9) AS department, CASE WHEN regexp_matches(substr(TEXT, 1, 4), '(?i)department|jabatan|unit|bahagian') THEN substr(TEXT, 1, 4) ELSE 'Unknown Department' END AS short")
_text("contact_fees", lambda t: [tx.contacts(t)[k].alias(k) for k in ("phone", "email", "fee")], f"nullif(regexp_extract(text, '{tx.PHONE}', 0), '') AS phone, nullif(regexp_extract(text, '{tx.EMAIL}', 0), '') AS email, nullif(regexp_extract(text, '{tx.FEE}', 0), '') AS fee")
_text("content_score", lambda t: [F.round(tx.content_score(t), 4).alias("score")], "round(CASE WHEN length(text) < 100 THEN 0 ELSE least(length(text) / 100.0::DOUBLE, 100) + 2 * len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: length(regexp_replace(s, '^\\s+|\\s+$', '', 'g')) > 10)) + 50.0::DOUBLE * len(list_distinct(string_split_regex(lower(text), '\\s+'))) / len(string_split_regex(lower(text), '\\s+')) + 5 * (" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in tx.GOV_KEYWORDS) + ") END, 4) AS score")
_text("confidence_completeness", lambda t: [F.round(tx.confidence(t), 6).alias("confidence"), F.round(tx.completeness(t), 6).alias("completeness")], f"round(least(1.0::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * ((length(text) > 100)::INT + (length(text) > 500)::INT + regexp_matches(text, '\\d+\\.|[A-Z]\\.|•|-')::INT + regexp_matches(text, '(?i)eligib|require|apply|contact')::INT + regexp_matches(text, '{tx.DATE}')::INT + regexp_matches(text, '(?i)ministry|kementerian|government|kerajaan')::INT)), 6) AS confidence, round(CASE WHEN k = 0 THEN 0.5::DOUBLE ELSE k / 6.0::DOUBLE END, 6) AS completeness")
ORACLE_SQL["confidence_completeness"] = ORACLE_SQL["confidence_completeness"].replace("FROM documents", "FROM (SELECT *, " + " + ".join(f"regexp_matches(text, '(?i){p}')::INT" for p in ("eligib|layak", "apply|mohon", "require|perlu|dokumen", "contact|hubungi", "benefit|bantuan|faedah")) + f" + (len(regexp_extract_all(text, '{tx.DATE}')) > 1)::INT AS k FROM documents)")
_trimmed = lambda x: f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_PAGE_NO = r"(?i)^Page\s+\d+$|^\d+\s*$|^Halaman\s+\d+$|^Muka\s+Surat\s+\d+$"
_HEAD = "(?i)^(MINISTRY|KEMENTERIAN|DEPARTMENT|JABATAN)|^(GOVERNMENT OF|KERAJAAN)|^(OFFICIAL|RASMI|CONFIDENTIAL|SULIT)"
_NAV = "(?i)^(HOME|UTAMA|BACK|KEMBALI|NEXT|SETERUSNYA|PREVIOUS|SEBELUM)$|^(MENU|NAVIGATION|NAVIGASI)$|^(SEARCH|CARI|LOGIN|LOG MASUK)$"
_PHRASES = "(?i)^(Application Process|Proses Permohonan)$|^(Required Documents|Dokumen Diperlukan)$|^(Contact Information|Maklumat Hubungan)$|^(Terms and Conditions|Terma dan Syarat)$"
# Documents between lines of the kinds that the line rules look for.
_AROUND = "Page 3\n  \tHOME \u00c2\nApplication process\n\u00a0Kerajaan Malaysia\nHalaman 12\n\n\n\nname\nname\nx\nx\n"
_LINES = "('Page 3' || chr(10) || '  ' || chr(9) || 'HOME ' || chr(194) || chr(10) || 'Application process' || chr(10) || chr(160) || 'Kerajaan Malaysia' || chr(10) || 'Halaman 12' || chr(10) || chr(10) || chr(10) || chr(10) || 'name' || chr(10) || 'name' || chr(10) || 'x' || chr(10) || 'x' || chr(10) || text || chr(10) || 'APPLICATION PROCESS' || chr(10) || 'name' || chr(10) || 'sulit' || chr(10) || 'â€œq')"


def _lined(name: str, build, sql: str) -> None:
    _text(name, lambda t: build(F.concat(F.lit(_AROUND), t, F.lit("\nAPPLICATION PROCESS\nname\nsulit\nâ€œq"))), sql.replace("TEXT", _LINES))


def _without(lines: str, *patterns: str) -> str:
    return f"list_filter({lines}, lambda l: " + " AND ".join(f"NOT regexp_matches({_trimmed('l')}, '{p}')" for p in patterns) + ")"


def _kept(lines: str, most: int, key) -> str:
    """Lines of which fewer than most before have their key; short ones all."""
    keys = f"list_transform({lines}, lambda m: {key('m')})"
    return f"list_filter({lines}, lambda l, i: length({_trimmed('l')}) < 3 OR len(list_filter({keys}[1:i - 1], lambda m: m = {key('l')})) < {most})"


_PHRASE_KEY = lambda l: f"CASE WHEN regexp_matches({_trimmed(l)}, '{_PHRASES}') THEN 'PHRASE:' || lower({_trimmed(l)}) ELSE {_trimmed(l)} END"  # noqa: E731, E741
_split = "string_split(TEXT, chr(10))"
_lined("line_filters", lambda t: [F.md5(tx.drop_lines(tx.drop_lines(tx.drop_lines(t, tx.PAGE_NUMBER), tx.HEADER), tx.NAVIGATION)).alias("digest"), tx.count_lines(t, tx.PAGE_NUMBER).alias("page_numbers")], f"md5(array_to_string({_without(_split, _PAGE_NO, _HEAD, _NAV)}, chr(10))) AS digest, CAST(len({_split}) - len({_without(_split, _PAGE_NO)}) AS INTEGER) AS page_numbers")
_lined("dedupe_lines", lambda t: [F.md5(tx.dedupe_lines(t)).alias("digest")], f"md5(array_to_string({_kept(_split, 1, _PHRASE_KEY)}, chr(10))) AS digest")
_lined("keep_two_repeats", lambda t: [F.md5(tx.keep_repeats(t, 2)).alias("digest")], f"md5(array_to_string({_kept(_split, 2, _trimmed)}, chr(10))) AS digest")
_lined("consecutive_lines", lambda t: [F.md5(tx.consecutive_lines(t)).alias("digest")], f"md5(array_to_string(list_filter({_split}, lambda l, i: {_trimmed('l')} <> '' AND (i = 1 OR {_trimmed(_split + '[i - 1]')} <> {_trimmed('l')})), chr(10))) AS digest")
_BAD = (("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("â€¢", "•"), ('â€"', "–"), ("Â", ""), ("\u00a0", " "), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2013", "–"), ("\u2014", "—"), ("\u2022", "•"))


def _encoding() -> tuple[str, str]:
    """SQL of the repaired text, and of the number of repairs."""
    text, n = "TEXT", "0"
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    for bad, good in _BAD:
        n += f" + (length({text}) - length(replace({text}, {quote(bad)}, ''))) // {len(bad)}"
        text = f"replace({text}, {quote(bad)}, {quote(good)})"
    return text, n


_FIXED, _FIXES = _encoding()
_SPACED = f"replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_FIXED}, '[ \\t]+', ' ', 'g'), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), '(?m)^[ \\t]{{1,4}}', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_lined("encoding_repair", lambda t: [F.md5(tx.fix_encoding(t)).alias("digest"), tx.encoding_fixes(t).cast("long").alias("fixes")], f"md5({_FIXED}) AS digest, CAST({_FIXES} AS BIGINT) AS fixes")
_lined("whitespace_rules", lambda t: [F.md5(tx.normalize_space(tx.fix_encoding(t))).alias("digest")], f"md5({_SPACED}) AS digest")
_lined("normalize_text", lambda t: [F.md5(tx.normalization(t)["text"]).alias("digest"), *[tx.normalization(t)[c].cast("long").alias(c) for c in ("encoding_fixed", "page_numbers_removed", "duplicates_removed")]], "md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(kept, chr(10)), '^\\n+|\\n+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS digest, CAST(fixes AS BIGINT) AS encoding_fixed, CAST(len(l0) - len(l1) AS BIGINT) AS page_numbers_removed, CAST(len(l2) - len(kept) AS BIGINT) AS duplicates_removed")
ORACLE_SQL["normalize_text"] = ORACLE_SQL["normalize_text"].replace("FROM documents", f"FROM (SELECT *, {_kept('l2', 1, _PHRASE_KEY)} AS kept FROM (SELECT *, {_without('l1', _HEAD, _NAV)} AS l2 FROM (SELECT *, {_without('l0', _PAGE_NO)} AS l1 FROM (SELECT doc_id, string_split({_SPACED}, chr(10)) AS l0, {_FIXES} AS fixes FROM documents))))".replace("TEXT", _LINES))
_lined("ocr_repair", lambda t: [F.md5(tx.fix_ocr(t)).alias("digest")], "md5(" + "regexp_replace(" * 7 + "TEXT, '\\b1\\b', 'I', 'g'), '\\b0\\b', 'O', 'g'), 'rn', 'm', 'g'), '\\|', 'l', 'g'), '(?i)Kerajaan', 'Kerajaan', 'g'), '(?i)Malaysia', 'Malaysia', 'g'), '(?i)Kementerian', 'Kementerian', 'g')) AS digest")
_lined("semantic_boundaries", lambda t: [_joined(F.array_sort(tx.boundaries(t)), "kinds")], f"array_to_string(list_filter(['list_item', 'question', 'section_header'], lambda k: len(list_filter({_split}, lambda l: CASE k WHEN 'section_header' THEN regexp_matches({_trimmed('l')}, '^[A-Z][A-Z\\s]+:?$|^\\d+\\.') WHEN 'list_item' THEN regexp_matches({_trimmed('l')}, '^[•\\-\\*]|^\\d+\\)') ELSE {_trimmed('l')} LIKE '%?' END)) > 0), ',') AS kinds")
_text("section_type", lambda t: [tx.section_type(F.substring_index(t, " ", 6)).alias("kind")], "CASE " + " ".join("WHEN " + " OR ".join(f"contains(h, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in (("eligibility", ("eligib", "kelayakan")), ("benefits", ("benefit", "manfaat", "faedah")), ("process", ("process", "proses", "cara", "how to")), ("requirements", ("require", "document", "dokumen")), ("fees", ("fee", "cost", "bayaran", "kos")), ("contact", ("contact", "hubungi")))) + " ELSE 'other' END AS kind")
ORACLE_SQL["section_type"] = ORACLE_SQL["section_type"].replace("FROM documents", "FROM (SELECT doc_id, lower(array_to_string(string_split(text, ' ')[1:6], ' ')) AS h FROM documents)")
_text("preview_key", lambda t: [F.md5(tx.preview(t)).alias("preview"), tx.query_key(F.concat(F.lit(" \t"), t)).alias("query_key")], "md5(substr(text, 1, 300) || '...') AS preview, sha256(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS query_key")
_text("overlap_and_cut", lambda t: [F.md5(tx.overlap_tail(t)).alias("overlap"), tx.sentence_cut(t, 200).cast("long").alias("cut")], "md5(CASE WHEN length(text) <= 100 THEN text WHEN instr(right(text, 100), '. ') > 1 THEN substr(right(text, 100), instr(right(text, 100), '. ') + 2) ELSE right(text, 100) END) AS overlap, CASE WHEN length(text) <= 200 THEN length(text) WHEN contains(text[1:200], '.') AND 200 - instr(reverse(text[1:200]), '.') > 140 THEN 200 - instr(reverse(text[1:200]), '.') + 1 ELSE 200 END AS cut")
_text("paragraph_chunks", lambda t: [F.size(tx.paragraphs(t)).cast("long").alias("paragraphs"), F.size(tx.sentences(t)).cast("long").alias("sentences")], "len(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda p: trim(p) <> '')) AS paragraphs, len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: length(regexp_replace(s, '^\\s+|\\s+$', '', 'g')) > 10)) AS sentences")
_text("collapse_space", lambda t: [F.md5(tx.collapse(t)).alias("digest")], "md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest")


@query("sentence_chunks", "documents", sql="SELECT doc_id, CAST(pos AS INT) AS chunk_index, md5(chunks[pos + 1]) AS digest FROM (SELECT doc_id, chunks, unnest(range(0, len(chunks))) AS pos FROM (SELECT doc_id, CASE WHEN len(p) = 0 THEN [text] ELSE CASE WHEN f.cur <> '' THEN list_append(f.done, trim(f.cur, ' ')) ELSE f.done END END AS chunks FROM (SELECT doc_id, text, p, list_reduce(list_prepend({'done': CAST([] AS VARCHAR[]), 'cur': ''}, list_transform(p, lambda x: {'done': CAST([] AS VARCHAR[]), 'cur': x})), lambda s, x: CASE WHEN length(s.cur) + length(x.cur) > 1000 AND s.cur <> '' THEN {'done': list_append(s.done, trim(s.cur, ' ')), 'cur': x.cur} ELSE {'done': s.done, 'cur': CASE WHEN s.cur = '' THEN x.cur ELSE s.cur || '. ' || x.cur END} END) AS f FROM (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS p FROM documents))))")
def _(d):
    return d.select("doc_id", F.posexplode(tx.sentence_chunks(F.col("text"))).alias("chunk_index", "c")).select("doc_id", "chunk_index", F.md5("c").alias("digest"))


def _rows(name: str, *tables: str):
    """A query without SQL: its operator parses HTML or runs a stream."""
    return query(name, *tables)


@_rows("html_clean", "pages")
def _(p):
    return html.clean_pages(p)


@_rows("html_sections", "pages")
def _(p):
    return html.sections(p)


@_rows("html_links", "pages")
def _(p):
    return html.links(p)


# Pages end in a table, images and links to further pages, which the pages given do not have.
_FRAGMENT = "<table summary='s'><caption>Fees</caption><thead><tr><th colspan='2'>A</th><th>B</th></tr></thead><tbody><tr><td><a href='/x'>go</a><a>no</a></td><td><ul><li>a</li><li>b</li></ul></td><td>7</td></tr></tbody></table><img alt='A map of offices'><img alt='ab'><a href='/list?page=2'>2</a><div class='pager'><a href='/list?page=3'>Next</a></div><a rel='next' href='/list?page=2'>more</a>"


def _ended(name: str, build, sql: str) -> None:
    query(name, "pages", sql=sql)(lambda p: build(p.withColumn("html", F.concat("html", F.lit(_FRAGMENT)))))


_ended("html_tables", lambda p: html.tables(p).withColumns({c: F.array_join(c, "|") for c in ("headers", "rows")}), "SELECT page_id, 'Fees' AS caption, 's' AS summary, 'A||B' AS headers, CAST(1 AS INTEGER) AS n_rows, CAST(3 AS INTEGER) AS n_columns, 'go (/x), no' || chr(9) || 'a; b' || chr(9) || '7' AS rows, 'complex' AS kind FROM pages")
_ended("html_images", html.images, "SELECT page_id, CAST(0 AS INTEGER) AS ord, 'A map of offices' AS alt FROM pages")
_ended("html_pagination", html.paginations, "SELECT page_id, CAST(n AS INTEGER) AS ord, regexp_extract(url, '^[a-z]+://[^/]+') || '/list?page=' || (n + 2) AS link FROM pages, range(2) t(n)")


for _name, _form in (("html_structure", html.structures), ("section_chunks", html.section_chunks), ("document_chunks", html.chunked_documents), ("chunking_totals", lambda p: html.chunking_totals(html.semantic_chunks(p))), ("section_rollup", lambda p: mo.section_rollup(html.sections(p)))):
    _rows(_name, "pages")(_form)
_rows("pattern_sections", "documents")(html.pattern_sections)
_rows("plain_text_chunks", "documents")(html.plain_text_chunks)


@_rows("semantic_chunks", "pages")
def _(p):
    return html.semantic_chunks(p)


@_rows("chunk_metadata", "pages")
def _(p):
    return html.chunk_metadata(p)


@_rows("rule_extraction", "pages")
def _(p):
    return html.rules(p)


QUERIES["stream_daily_crawls"] = lambda s, sf: jobs.daily_crawls(s, sf).withColumn("day", F.col("day").cast("string"))
ORACLE_SQL["stream_daily_crawls"] = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"
QUERIES["embed_queue_drain"] = jobs.drain_queue
_DONE = "status = 'pending' AND message <> 'bad input' AND document_id % 2 = 0"
_AGAIN = "status = 'pending' AND NOT (message <> 'bad input' AND document_id % 2 = 0) AND regexp_matches(message, '(?i)timeout|502|503|fetch') AND attempts + 1 < 3"
ORACLE_SQL["embed_queue_drain"] = duck(f"SELECT id, CASE WHEN status <> 'pending' THEN status WHEN {_DONE} THEN 'completed' WHEN {_AGAIN} THEN 'pending' ELSE 'failed' END AS status, CAST(CASE WHEN {_AGAIN} THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts FROM queue", "queue")


# Sources: sitemaps and robots files written from the addresses of pages.
_ENTRY = "concat('<url><loc>', url, '</loc>', CASE WHEN page_id % 3 <> 0 THEN '<lastmod>2024-01-02T03:04:05Z</lastmod>' ELSE '' END, CASE WHEN page_id % 2 = 0 THEN '<priority>0.8</priority>' ELSE '' END, '</url>')"


def _sitemaps(spark, sf):
    """Ten sitemaps of pages, an index of them, one that is missing and one that is broken."""
    p = spark.read.parquet(f"{sf}/pages.parquet").select((F.col("page_id") % 10).alias("n"), F.replace("url", F.lit("&"), F.lit("&amp;")).alias("url"), "page_id")
    sets = p.groupBy("n").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.expr(_ENTRY)), ""), F.lit("</urlset>")).alias("xml")).select(F.concat(F.lit("/s"), F.col("n").cast("string")).alias("location"), "xml")
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>/s{n}</loc></sitemap>" for n in range(11)) + "<sitemap><loc>/bad</loc></sitemap></sitemapindex>"
    return sets.unionByName(spark.createDataFrame([("/index", index), ("/bad", "<urlset><url><loc>x")], "location string, xml string"))


_sql("sitemap_tree", "SELECT url, page_id % 3 <> 0 AS dated, CASE WHEN page_id % 2 = 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS priority FROM pages", lambda s, sf: readers.sitemap_tree(_sitemaps(s, sf), ["/index"]).select("url", F.col("lastmod").isNotNull().alias("dated"), "priority"))
_sql("sitemap_entries", "SELECT url FROM pages WHERE page_id % 10 = 3", lambda s, sf: readers.sitemap_entries(_sitemaps(s, sf).where("location = '/s3'")).select("url"))
_ROBOTS = "'User-agent: *' || chr(10) || 'Disallow: /' || n || chr(10) || ' DISALLOW:  /Private' || chr(10) || 'Allow: /' || n || '5'"
_PATHS = "SELECT page_id, page_id % 7 AS n, '/' || (page_id % 13) || CAST(page_id % 10 AS VARCHAR(9)) || '/x' AS path FROM pages"


@query("robots_gate", "pages", sql=f"SELECT page_id, NOT starts_with(path, '/' || n) OR starts_with(path, '/' || n || '5') AS allowed FROM ({_PATHS})")
def _(p):
    d = p.select("page_id", (F.col("page_id") % 7).cast("string").alias("n"), F.concat(F.lit("/"), (F.col("page_id") % 13).cast("string"), (F.col("page_id") % 10).cast("string"), F.lit("/x")).alias("path"))
    d = d.withColumn("r", co.robots_rules(F.concat(F.lit("User-agent: *\nDisallow: /"), "n", F.lit("\n DISALLOW:  /Private\nAllow: /"), "n", F.lit("5"))))
    return d.select("page_id", co.robots_allowed(F.col("path"), F.col("r.disallow"), F.col("r.allow")).alias("allowed"))


_FETCH = "SELECT event_id AS id, CAST(CASE user_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 304 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 503 ELSE 302 END AS INT) AS status, CAST(event_id % 3 + 1 AS INT) AS attempt, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 50 AS INT) END AS retry_after, CASE WHEN event_id % 5 = 0 THEN 'tag' END AS etag FROM events"
_sql("fetch_outcomes", f"SELECT id, CASE WHEN status = 304 THEN 'not_modified' WHEN status = 200 THEN 'modified' WHEN status <> 404 AND attempt < 3 THEN 'retry' ELSE 'error' END AS outcome, CAST(CASE WHEN status IN (302, 429, 503) AND attempt < 3 THEN (attempt + 1) * 5000 + CASE WHEN status = 429 THEN coalesce(retry_after * 1000, 30000) ELSE 0 END ELSE 0 END AS BIGINT) AS wait_ms, CASE WHEN etag IS NOT NULL THEN 'If-None-Match' ELSE '' END AS headers FROM ({_FETCH})", lambda s, sf: (register(s, sf, _FETCH), s.sql(_FETCH).withColumn("o", co.fetch_outcome(F.col("status"), F.col("attempt"), F.col("retry_after"))).select("id", "o.*", F.array_join(F.map_keys(co.request_headers(F.col("etag"), F.lit(None).cast("string"))), ",").alias("headers")))[1])
_ERRORS = "SELECT event_id AS id, CASE user_id % 4 WHEN 0 THEN '23505' WHEN 1 THEN '42P01' WHEN 2 THEN '57014' END AS code, CASE event_id % 3 WHEN 0 THEN 'Permission DENIED for table' WHEN 1 THEN 'connection reset' END AS message, CAST(event_id % 8 + 1 AS INT) AS attempt FROM events"
_sql("database_retries", f"SELECT id, coalesce(code IN ('23505', '42501', '42P01'), false) OR coalesce(lower(message) LIKE '%permission denied%', false) AS final, CAST(least(1000 * pow(2, attempt - 1), 30000) AS BIGINT) AS delay_ms FROM ({_ERRORS})", lambda s, sf: (register(s, sf, _ERRORS), s.sql(_ERRORS).select("id", co.is_final(F.col("code"), F.col("message")).alias("final"), co.retry_delay(F.col("attempt")).alias("delay_ms")))[1])


@query("pdf_and_ocr", "pages", sql="SELECT page_id, page_id % 4 = 0 AS pdf, page_id % 3 <> 0 OR page_id % 2 = 0 AS ocr, CASE WHEN page_id % 10 > 6 THEN 'accept' WHEN page_id % 10 > 3 THEN 'low_confidence' ELSE 'drop' END AS bucket, 'a b c' AS cleaned FROM pages")
def _(p):
    i = F.col("page_id")
    url = F.concat("url", F.when(i % 4 == 0, ".PDF?x=1").otherwise(".html"))
    alt = F.when(i % 2 == 0, "an IMAGE of nothing").when(i % 3 == 0, "a telling description").otherwise("short")
    return p.select("page_id", readers.is_pdf(url).alias("pdf"), readers.wants_ocr(F.lit("/a/B.JPG?x"), alt).alias("ocr"), readers.ocr_bucket((i % 10) / 10).alias("bucket"), readers.clean_pdf_text(F.lit(" a\n\fb \u00a0 c\r")).alias("cleaned"))


@query("point_lookup", "sources", sql="SELECT source_id, name FROM sources WHERE source_id = 7")
def _(s):
    return co.exactly_one(s.where("source_id = 7").select("source_id", "name"))


_DOCS = "SELECT doc_id AS id, 'u' || (doc_id % 50) AS url, 'u' || (doc_id % 50) AS source_url, sha256(text) AS content_hash, CASE WHEN doc_id % 3 = 0 THEN 'gov_crawled' ELSE 'user_created' END AS document_type FROM documents"


@query("existing_document_match", "documents", sql=f"SELECT a.id, min(b.id) AS document_id FROM ({_DOCS}) a LEFT JOIN ({_DOCS}) b ON a.url = b.source_url AND a.content_hash = b.content_hash AND b.document_type = 'gov_crawled' GROUP BY 1")
def _(d):
    d = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), (F.col("doc_id") % 50).cast("string")).alias("url"), F.sha2("text", 256).alias("content_hash"), F.when(F.col("doc_id") % 3 == 0, "gov_crawled").otherwise("user_created").alias("document_type"))
    return co.existing_document(d.select("id", "url", "content_hash"), d.withColumnRenamed("url", "source_url")).select("id", "document_id")


@query("guarded_upsert", "documents", sql="SELECT doc_id, version, n FROM (SELECT doc_id, 1 AS version, length(text) AS n FROM documents WHERE doc_id % 2 = 0 AND length(text) > 1000 UNION ALL SELECT doc_id, 2, length(text) FROM documents WHERE length(text) <= 1000)")
def _(d):
    rows = d.select("doc_id", F.lit(1).alias("version"), F.length("text").cast("long").alias("n"), F.repeat(F.lit("x"), F.when(F.length("text") <= 1000, 1).otherwise(1_000_001)).alias("content"), F.lit(None).cast("string").alias("raw_content"))
    old = rows.where("doc_id % 2 = 0").withColumn("content", F.lit("x"))
    return co.guarded_upsert(old, rows.withColumn("version", F.lit(2)), ["doc_id"], "version")[0].select("doc_id", "version", "n")


@query("vector_stats_by_doc", "two_vectors", sql="SELECT document_id, count(*) AS total_chunks, count(embedding_small) AS with_small, count(embedding_large) AS with_large, round(avg(token_count), 6) AS avg_tokens FROM two_vectors GROUP BY 1")
def _(c):
    return mo.vector_stats(c)


_EMBEDDED = "SELECT doc_id AS id, CASE WHEN doc_id % 4 <> 0 THEN TIMESTAMP '2024-01-02 00:00:00' END AS updated_at, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-01-03 00:00:00' END AS embedded_at, sha256(text) AS content_hash FROM documents"
_SPARK_EMBEDDED = _EMBEDDED.replace("sha256(text)", "sha2(text, 256)")
_sql("embedding_status", f"SELECT id, embedded_at IS NULL OR coalesce(updated_at > embedded_at, false) AS needs_update, coalesce(n, 0) AS chunk_count FROM (SELECT * FROM ({_EMBEDDED}) ORDER BY id LIMIT 50) LEFT JOIN (SELECT vec_id % 40 AS id, count(*) AS n FROM embeddings GROUP BY 1) USING (id)", lambda s, sf: (register(s, sf, _SPARK_EMBEDDED, "embeddings"), mo.embedding_status(s.sql(_SPARK_EMBEDDED), s.sql("SELECT vec_id % 40 AS document_id FROM embeddings"), co.stale(F.col("updated_at"), F.col("embedded_at"))))[1])
for _mode, _where in (("stale", "embedded_at IS NULL OR updated_at > embedded_at"), ("one", "id = 5"), ("force", "id = 5")):
    _sql(f"embedding_refresh_{_mode}", f"SELECT id, {'NULL' if _mode == 'force' else 'content_hash'} AS content_hash FROM ({_EMBEDDED}) WHERE {_where}", lambda s, sf, mode=_mode: (register(s, sf, _SPARK_EMBEDDED), co.refresh(s.sql(_SPARK_EMBEDDED), mode, 5).select("id", "content_hash"))[1])


@query("relative_times", "metrics", sql="SELECT id, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE strftime(ts, '%Y-%m-%d') END AS label FROM (SELECT id, ts, CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 60000000) AS BIGINT) AS m FROM metrics)")
def _(m):
    return m.select("id", tx.relative_time(F.col("ts"), now()).alias("label"))


_ASKED = "SELECT c_custkey AS user_id, 1 AS messages, 17 AS tokens FROM customer WHERE c_custkey % 3 = 0"


@query("usage_increment", "plans", "customer", sql=f"SELECT user_id, json_object('messages_used', CASE WHEN cycle_end < {NOW} THEN 0 ELSE messages_used END + coalesce(messages, 0), 'messages_limit', messages_limit, 'tokens_used', CASE WHEN cycle_end < {NOW} THEN 0 ELSE tokens_used END + coalesce(tokens, 0))::VARCHAR AS result FROM plans LEFT JOIN ({_ASKED}) USING (user_id)")
def _(p, c):
    asked = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.lit(1).alias("messages"), F.lit(17).alias("tokens"))
    return co.increment(p, asked, now()).select("user_id", co.usage_json().alias("result"))


@query("stored_with_triggers", "kb_documents", sql="SELECT id, CASE WHEN id % 2 = 1 OR id % 6 = 0 THEN CASE WHEN id % 3 = 0 THEN 1.0 ELSE 0.7 END ELSE 0.33 END::DOUBLE AS trust_level FROM kb_documents")
def _(d):
    old = d.where("id % 2 = 0").select("id", F.when(F.col("id") % 6 == 0, "other").otherwise(F.col("document_type")).alias("document_type"), F.lit("0.33").cast("decimal(3,2)").alias("trust_level"))
    return co.with_triggers(old, d, "id", now()).select("id", F.col("trust_level").cast("double").alias("trust_level"))


@query("unique_violations", "orders", sql="SELECT o_custkey, o_orderstatus, count(*) AS rows FROM orders GROUP BY ALL HAVING count(*) > 1")
def _(o):
    return co.duplicates(o, ["o_custkey", "o_orderstatus"])


@query("orphan_rows", "orders", "sources", sql="SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT source_id FROM sources WHERE is_active)")
def _(o, s):
    return co.orphans(o, s.where("is_active"), "o_custkey", "source_id").select("o_orderkey")


@query("replaced_children", "orders", sql="SELECT o_custkey, o_orderkey FROM orders WHERE (o_orderkey % 2 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 1)) OR o_orderkey % 5 = 1")
def _(o):
    o = o.select("o_custkey", "o_orderkey")
    return co.replace_children(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 5 = 1"), "o_custkey")


@query("folders_created", "documents", sql="SELECT DISTINCT source AS name, CASE WHEN source IN ('src0', 'src1') THEN 'old' ELSE sha256(source) END AS id FROM documents UNION SELECT * FROM (VALUES ('src0', 'old'), ('src1', 'old'))")
def _(d):
    folders = d.sparkSession.createDataFrame([("src0", "old"), ("src1", "old")], "name string, id string")
    return co.get_or_create(folders, d.select(F.col("source").alias("name")))


@query("page_status_updates", "crawl_pages", sql="SELECT 'u' || page_id AS url, CASE WHEN page_id % 4 = 0 THEN 'success' ELSE status END AS status FROM crawl_pages")
def _(p):
    pages = p.select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url"), "status")
    changes = p.where("page_id % 4 = 0").select(F.explode(F.array("page_id", -F.col("page_id"))).alias("i")).select(F.concat(F.lit("u"), F.col("i").cast("string")).alias("url"), F.lit("success").alias("status"))
    return co.update_status(pages, changes.union(changes))


@query("enqueue_chunks", "text_chunks", sql="SELECT document_id || '_' || chunk_id || '_1706659200000' AS id, 'pending' AS status, attempts, length(chunk_text) AS n FROM text_chunks, (SELECT CAST(0 AS INTEGER) AS attempts)")
def _(c):
    return co.enqueue(c, now()).select("id", "status", "attempts", F.length("chunk_text").cast("long").alias("n"))


_OK = "document_id % 3 = 0"
_RUN = f"status = 'pending' AND NOT {_OK} AND regexp_matches(message, '(?i)timeout|502|503|fetch') AND attempts + 1 < 3"


@query("queue_run", "queue", sql=f"SELECT id, CASE WHEN status <> 'pending' THEN status WHEN {_OK} THEN 'completed' WHEN {_RUN} THEN 'pending' ELSE 'failed' END AS status, CAST(CASE WHEN {_RUN} THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts, (status = 'pending' AND NOT ({_RUN})) OR processed_at IS NOT NULL AS done FROM queue")
def _(q):
    return co.process(q, F.col("document_id") % 3 == 0, F.col("message"), now()).select("id", "status", "attempts", F.col("processed_at").isNotNull().alias("done"))


@query("queue_of_document", "queue", sql="SELECT id FROM queue WHERE document_id = 3 AND status = 'pending'")
def _(q):
    return co.of_document(q, 3).select("id")


@query("crawl_jobs", "crawl_pages", sql="SELECT 'u' || page_id AS url, CAST(coalesce(d, 0) + 1 AS INTEGER) AS depth FROM (SELECT page_id, CASE WHEN page_id % 5 < 4 THEN page_id % 5 END AS d FROM crawl_pages) WHERE d IS NULL OR d < 3")
def _(p):
    links = p.select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url"), "source_id", F.when(F.col("page_id") % 5 < 4, F.col("page_id") % 5).alias("depth"))
    return co.publish(links).select("url", "depth")


@query("crawl_job_batch", "pages", sql="SELECT 'crawl' AS type, url, page_id AS source_id FROM pages")
def _(p):
    return co.publish_batch(p.select("url", F.col("page_id").alias("source_id")))


@query("url_slice_state", "pages", sql="SELECT url, page_id, greatest((SELECT count(*) FROM pages) - 60, 0) AS remaining, (SELECT count(*) FROM pages) > 60 AS has_more FROM (SELECT url, page_id, row_number() OVER (ORDER BY url, page_id) AS rn FROM pages) WHERE rn BETWEEN 11 AND 60")
def _(p):
    return co.slice_of(p.select("url", "page_id"), 10)


@query("continuations", "sources", sql="SELECT source_id, CASE WHEN source_id % 3 <> 0 THEN '/next?offset=' || (source_id * 50) END AS url FROM sources")
def _(s):
    c = co.continuation(F.lit("/next"), F.col("source_id") * 50, F.col("source_id") % 3 != 0)
    return s.select("source_id", c["url"].alias("url"))


@query("query_cache_touch", "benchmark", sql="SELECT query_key, coalesce(h, 0) + coalesce(n, 0) AS hit_count FROM (SELECT sha256(lower(text)) AS query_key, item_id % 3 AS h FROM benchmark WHERE item_id % 2 = 0) FULL JOIN (SELECT sha256(lower(text)) AS query_key, count(*) AS n FROM benchmark, range(2) WHERE item_id % 3 = 0 GROUP BY 1) USING (query_key)")
def _(b):
    keyed = b.select("item_id", tx.query_key(F.concat(F.lit("  "), "text", F.lit("\n"))).alias("query_key"))
    return co.touch_cache(keyed.where("item_id % 2 = 0").select("query_key", (F.col("item_id") % 3).alias("hit_count")), keyed.where("item_id % 3 = 0").withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2)))))


@query("row_count", "documents", sql="SELECT count(*) AS n FROM documents WHERE lang IS NOT NULL")
def _(d):
    return d.where("lang is not null").agg(F.count(F.lit(1)).alias("n"))


@query("truncate_html", "pages", sql="SELECT page_id, md5(CASE WHEN length(html) <= 2000 THEN html ELSE substr(html, 1, 2000) || chr(10) || chr(10) || '[Content truncated due to size limits]' END) AS digest, length(html) > 2000 AS truncated, round(least(length(html), 2000) / length(html), 6) AS ratio FROM pages")
def _(p):
    t = tx.truncation(F.col("html"), 2000)
    return p.select("page_id", F.md5(tx.truncate(F.col("html"), 2000)).alias("digest"), t["truncated"].alias("truncated"), F.round(t["ratio"], 6).alias("ratio"))


# Searches as callers ask for them, over chunks that have a text and a vector.
_STOPS = "('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'in', 'is', 'it', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'was', 'were', 'will', 'with')"
_STEM = "CASE WHEN length(regexp_replace(x, '(?:ings?|edly|ed|es|s|ly)$', '')) >= 4 THEN regexp_replace(x, '(?:ings?|edly|ed|es|s|ly)$', '') ELSE x END"
_SEEN = "(d.document_type = 'gov_crawled' OR d.user_id = 2) AND d.folder_id IN ('src0', 'src1', 'src2')"
_CALL = {"user_id": 2, "folders": ["src0", "src1", "src2"]}


def _found(words: list[str], k: int, kw: int, wv: float, wb: float, english: bool, seen: str = "true", threshold: float = 0.5) -> str:
    """vv and kw: what each half of a hybrid search finds; hh: their weighted union."""
    table = f"(SELECT chunk_id AS id, chunk_text AS content FROM text_chunks c JOIN kb_documents d ON d.id = c.document_id WHERE {seen})"
    bm = _bm25(words, "all", kw, table)
    if english:
        bm = bm.replace("lambda x: x <> '') AS t", f"lambda x: x <> '' AND x NOT IN {_STOPS}) AS t0").replace("tk AS (SELECT id AS id,", "tk AS (SELECT id, list_transform(t0, lambda x: " + _STEM + ") AS t FROM (SELECT id AS id,").replace(f"FROM {table}), ct", f"FROM {table})), ct")
    vec = f"SELECT c.chunk_id AS id, c.document_id, {_SIM} AS similarity FROM text_chunks c JOIN kb_documents d ON d.id = c.document_id, (SELECT embedding AS e FROM text_chunks WHERE chunk_id = 4) q WHERE {seen} AND {_SIM} > {threshold} ORDER BY {_SIM} DESC, c.chunk_id LIMIT {2 * k}"
    return duck("", "kb_documents", "text_chunks") + bm + f", vv AS ({vec}), hh AS (SELECT coalesce(vv.id, kw.id) AS id, coalesce(similarity, 0) AS v, coalesce(bm25_score, 0) AS b FROM vv FULL OUTER JOIN kw ON vv.id = kw.id), oo AS (SELECT id, round(v, 6) AS vector_score, round(b, 6) AS bm25_score, round({wv}::DOUBLE * v + {wb}::DOUBLE * b, 6) AS hybrid_score FROM hh ORDER BY {wv}::DOUBLE * v + {wb}::DOUBLE * b DESC, id LIMIT {k})"


def _search(name: str, sql: str, text: str, **options) -> None:
    def run(s, sf):
        c, d = _t(s, sf, "text_chunks"), _t(s, sf, "kb_documents")
        q = c.where("chunk_id = 4").select(F.col("embedding").alias("q"))
        out = se.search(c, d, text, q, **options)
        return out.select(*[F.round(x, 6).alias(x) if x.endswith(("score", "similarity")) else F.col(x) for x in out.columns])

    QUERIES[name], ORACLE_SQL[name] = run, sql


_search("search_vector", _found(["the"], 5, 5, 0.7, 0.3, False, _SEEN, 0.1) + " SELECT id, document_id, round(similarity, 6) AS similarity FROM vv ORDER BY similarity DESC, id LIMIT 10", "the", search_type="vector", match_count=10, vector_threshold=0.1, **_CALL)
_search("search_bm25_simple", _found(["and", "the"], 10, 10, 0.7, 0.3, False, _SEEN) + " SELECT id, round(bm25_score, 6) AS bm25_score FROM kw", "the AND the", search_type="bm25", use_simple_search=True, **_CALL)
_search("search_bm25_english", _found(["licens"], 10, 10, 0.7, 0.3, True) + " SELECT id, round(bm25_score, 6) AS bm25_score FROM kw", "the licensed", search_type="bm25")
_search("search_hybrid", _found(["licens"], 10, 20, 0.6, 0.4, True, "true", 0.2) + " SELECT * FROM oo", "licenses", search_type="hybrid", vector_weight=0.6, bm25_weight=0.4, vector_threshold=0.2)
_search("search_smart_keyword", _found(["licens"], 10, 20, 0.4, 0.6, True, "(d.document_type = 'gov_crawled' OR d.user_id = 2)") + " SELECT *, 'keyword_boosted' AS search_strategy FROM oo", '"licensed"', user_id=2)
_search("search_smart_semantic", _found(["licens"], 10, 20, 0.7, 0.3, True) + " SELECT *, 'semantic_primary' AS search_strategy FROM oo", "licensing of")


@query("text_index", "text_chunks", sql="SELECT chunk_id AS id, x AS term, count(*) AS tf, n AS len FROM (SELECT chunk_id, len(t) AS n, unnest(t) AS x FROM (SELECT chunk_id, list_filter(string_split_regex(lower(chunk_text || ' ' || section_heading), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM text_chunks)) GROUP BY ALL")
def _(c):
    return se.postings(c, "chunk_id", "chunk_text", "section_heading").select("id", "term", "tf", F.col("len").cast("long").alias("len"))


@query("text_index_english", "text_chunks", sql=f"SELECT chunk_id AS id, x AS term, count(*) AS tf FROM (SELECT chunk_id, unnest(list_transform(list_filter(string_split_regex(lower(chunk_text), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN {_STOPS}), lambda x: {_STEM})) AS x FROM text_chunks) GROUP BY ALL")
def _(c):
    return se.postings(c, "chunk_id", "chunk_text", config="english").select("id", "term", "tf")


def _indexed(d):
    index = cut(se.postings(d, "id", "content"))
    total = d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(se.terms(F.col("content")))).alias("avgdl"))
    return _rounded(se.bm25_postings(index, total, ["and", "of", "the"]), "bm25_score")


QUERIES["bm25_from_index"] = lambda s, sf: _indexed(_t(s, sf, "kb_documents"))
ORACLE_SQL["bm25_from_index"] = ORACLE_SQL["bm25_all_terms"]


@query("dual_embeddings", "benchmark", sql="SELECT item_id, CAST(384 AS INTEGER) AS small, CAST(1024 AS INTEGER) AS large FROM benchmark")
def _(b):
    v = jobs.dual(F.col("text"))
    return b.select("item_id", F.size(v["small"]).alias("small"), F.size(v["large"]).alias("large"))
