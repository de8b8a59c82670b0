"""Vector, keyword and hybrid top-k search with visibility rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOV = "gov_crawled"
K1, B = 1.2, 0.75


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """1 minus cosine distance, in double precision; null for a zero vector (NaN would pass any threshold)."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def secure_view(docs: DataFrame, user_id=None, when_null: str = "gov") -> DataFrame:
    """Rows a caller may read: their own and government documents; without a caller, those or (when_null='all') all."""
    if user_id is None:
        return docs.where(F.col("document_type") == GOV) if when_null == "gov" else docs
    return docs.where((F.col("document_type") == GOV) | (F.col("user_id") == user_id))


def folder_scope(docs: DataFrame, folders: list | None = None) -> DataFrame:
    return docs if folders is None else docs.where(F.col("folder_id").isin(folders))


def vector_search(chunks: DataFrame, docs: DataFrame, query: list[float] | DataFrame, threshold: float, k: int, user_id=None, folders=None, when_null: str = "gov") -> DataFrame:
    """chunk_id, document_id, similarity of the k nearest visible chunks strictly over the threshold."""
    q = F.array(*[F.lit(float(x)) for x in query]) if isinstance(query, list) else F.col("q")
    base = chunks.where("embedding is not null") if isinstance(query, list) else chunks.where("embedding is not null").crossJoin(F.broadcast(query.select(F.col(query.columns[0]).alias("q")).limit(1)))
    visible = folder_scope(secure_view(docs, user_id, when_null), folders).select(F.col("id").alias("document_id"))
    hit = base.withColumn("similarity", cosine(F.col("embedding"), q)).where((F.col("similarity") > threshold) & ~F.isnan("similarity"))
    return hit.join(visible, "document_id", "left_semi").select("chunk_id", "document_id", "similarity").orderBy(F.desc("similarity"), "chunk_id").limit(k)


def two_stage(chunks: DataFrame, docs: DataFrame, small: DataFrame, large: DataFrame, k_coarse: int, k: int, **where) -> DataFrame:
    """The k best by their large vectors (embedding_large) of the k_coarse best by their small ones (embedding): small
    and large hold the query's vectors, one row each. Candidates without a large vector are out."""
    first = vector_search(chunks, docs, small, 0.0, k_coarse, **where).select("chunk_id", F.col("similarity").alias("coarse"))
    q = large.select(F.col(large.columns[0]).alias("q")).limit(1)
    again = chunks.select("chunk_id", "document_id", "embedding_large").join(F.broadcast(first), "chunk_id").crossJoin(F.broadcast(q))
    return again.withColumn("similarity", cosine(F.col("embedding_large"), F.col("q"))).where("similarity is not null").select("chunk_id", "document_id", "coarse", "similarity").orderBy(F.desc("similarity"), "chunk_id").limit(k)


# Words without weight, and endings that do not tell words apart, in the english configuration.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with")
ENDINGS = "(?:ings?|edly|ed|es|s|ly)$"
SHORTEST_STEM = 4


def terms(text: Column, config: str = "simple") -> Column:
    """Runs of letters and digits, lower-cased; english leaves out stop words and cuts endings off longer words."""
    out = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")
    if config == "simple":
        return out
    stem = lambda t: F.when(F.length(F.regexp_replace(t, ENDINGS, "")) >= SHORTEST_STEM, F.regexp_replace(t, ENDINGS, "")).otherwise(t)
    return F.transform(F.filter(out, lambda t: ~t.isin(*STOP_WORDS)), stem)


def query_terms(query: str, config: str = "simple") -> list[str]:
    """The different terms of a query, as terms() cuts them."""
    import re

    words = {w for w in re.split("[^a-z0-9]+", query.lower()) if w}
    if config == "simple":
        return sorted(words)
    return sorted({c if len(c := re.sub(ENDINGS, "", w)) >= SHORTEST_STEM else w for w in words - set(STOP_WORDS)})


def postings(chunks: DataFrame, id_col: str, text_col: str, heading_col: str | None = None, config: str = "simple") -> DataFrame:
    """(id, term, tf, len) over a text and its heading: written once as a table, it serves all keyword searches."""
    text = F.col(text_col) if heading_col is None else F.concat_ws(" ", text_col, heading_col)
    t = chunks.select(F.col(id_col).alias("id"), terms(text, config).alias("t"))
    return t.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_postings(index: DataFrame, total: DataFrame, words: list[str], k: int = 20, match: str = "all") -> DataFrame:
    """The same search over a written index and its totals (one row: n, avgdl); only the query's terms are read."""
    hit = index.where(F.col("term").isin(words))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = total.select("n", "avgdl").limit(1)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    scored = hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(n)).select("id", "term", part.alias("part"))
    out = scored.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.sum("part").alias("bm25_score"))
    out = out.where(F.col("terms") == len(words)) if match == "all" else out
    return out.select("id", "bm25_score").orderBy(F.desc("bm25_score"), "id").limit(k)


def _equals(w: str):
    return lambda x: x == w


def bm25(chunks: DataFrame, query: str, k: int = 20, match: str = "all", id_col: str = "id", text_col: str = "content", config: str = "simple") -> DataFrame:
    """Okapi BM25 of chunks with all (or any) of the query's distinct terms; idf = ln(1 + (N - df + .5) / (df + .5)).

    Only counts of the query's terms leave the scan, so nothing is exploded; a simple text is not even cut into terms,
    and a term is counted only in texts that contain its letters.
    """
    words = query_terms(query, config)
    low = F.lower(F.col(text_col))
    if config == "simple":
        length = F.coalesce(F.regexp_count(low, F.lit("[a-z0-9]+")), F.lit(0))
        tf = [F.when(F.contains(low, F.lit(w)), F.regexp_count(low, F.lit(f"(?<![a-z0-9]){w}(?![a-z0-9])"))).otherwise(0) for w in words]
        base = chunks
    else:
        base = chunks.select(F.col(id_col), terms(F.col(text_col), config).alias("t"))
        length, tf = F.coalesce(F.size("t"), F.lit(0)), [F.coalesce(F.size(F.filter("t", _equals(w))), F.lit(0)) for w in words]
    counted = base.select(F.col(id_col).alias("id"), length.alias("len"), *[c.alias(f"tf{n}") for n, c in enumerate(tf)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    need = (" and " if match == "all" else " or ").join(f"tf{i} > 0" for i in range(len(words))) or "false"
    both = counted.where(need).crossJoin(F.broadcast(stats))
    total = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        f = F.col(f"tf{i}")
        total = total + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return both.select("id", total.alias("bm25_score")).orderBy(F.desc("bm25_score"), "id").limit(k)


def query_weights(q: Column, pg_strict: bool = False) -> Column:
    """Vector and keyword weights by the kind of query: digits, codes of capitals and quotes favour keywords. Strictly
    as a Postgres pattern is read, the sign around codes is a backspace, so that codes never count."""
    exact = q.rlike(r"\d") | q.rlike('"[^"]+"')
    exact = exact if pg_strict else exact | q.rlike(r"\b[A-Z]{3,}\b")
    return F.struct(F.when(exact, 0.4).otherwise(0.7).alias("vector_weight"), F.when(exact, 0.6).otherwise(0.3).alias("bm25_weight"), F.when(exact, "keyword_boosted").otherwise("semantic_primary").alias("search_strategy"))


def hybrid(vector: DataFrame, keyword: DataFrame, vector_weight: float = 0.7, bm25_weight: float = 0.3, k: int = 10, normalize: bool = False) -> DataFrame:
    """Weighted sum of both scores on the union of candidates (id, similarity) and (id, bm25_score)."""
    both = vector.join(keyword, "id", "full_outer").select("id", F.coalesce("similarity", F.lit(0.0)).alias("vector_score"), F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"))
    if normalize:
        top = both.agg(F.max("bm25_score").alias("top"))
        both = both.crossJoin(F.broadcast(top)).withColumn("bm25_score", F.coalesce(F.col("bm25_score") / F.nullif("top", F.lit(0.0)), F.lit(0.0))).drop("top")
    return both.withColumn("hybrid_score", vector_weight * F.col("vector_score") + bm25_weight * F.col("bm25_score")).orderBy(F.desc("hybrid_score"), "id").limit(k)


def search(chunks: DataFrame, docs: DataFrame, query: str, query_vector=None, search_type: str = "smart", match_count: int = 10, user_id=None, folders=None, vector_weight: float = 0.7, bm25_weight: float = 0.3, vector_threshold: float = 0.5, use_simple_search: bool = False, text_col: str = "chunk_text") -> DataFrame:
    """One search by type: vector, bm25, hybrid (weights given) or smart (weights from the query's kind, threshold and
    configuration as by default). Rows are id, the scores of the type, and for smart its search_strategy.

    query_vector is a list of numbers or a DataFrame of one row. Without a caller all documents are visible.
    """
    import re

    config = "simple" if use_simple_search else "english"
    if search_type == "vector":
        return vector_search(chunks, docs, query_vector, vector_threshold, match_count, user_id, folders, "all").select(F.col("chunk_id").alias("id"), "document_id", "similarity")
    vis = folder_scope(secure_view(docs, user_id, "all"), folders).select(F.col("id").alias("document_id"))
    keyword = bm25(chunks.join(vis, "document_id", "left_semi"), query, match_count if search_type == "bm25" else 2 * match_count, "all", "chunk_id", text_col, config)
    if search_type == "bm25":
        return keyword
    strategy = None
    if search_type == "smart":
        exact = re.search(r"\d|\b[A-Z]{3,}\b|\"[^\"]+\"", query)
        vector_weight, bm25_weight, strategy = (0.4, 0.6, "keyword_boosted") if exact else (0.7, 0.3, "semantic_primary")
    vec = vector_search(chunks, docs, query_vector, vector_threshold, 2 * match_count, user_id, folders, "all").select(F.col("chunk_id").alias("id"), "similarity")
    out = hybrid(vec, keyword, vector_weight, bm25_weight, match_count)
    return out if strategy is None else out.withColumn("search_strategy", F.lit(strategy))
