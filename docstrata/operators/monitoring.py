"""Crawl, queue and cache statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600


def percent(part, whole):
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), 2)


def chunk_stats(chunks: DataFrame, by: str = "document_id", vector: str = "embedding") -> DataFrame:
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("chunk_count"), F.count(vector).alias("embedded"), F.round(F.avg("chunk_index"), 6).alias("avg_index"))


def vector_stats(chunks: DataFrame, by: str = "document_id") -> DataFrame:
    """Chunks of each document with a small and with a large vector, and their mean tokens."""
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("total_chunks"), F.count("embedding_small").alias("with_small"), F.count("embedding_large").alias("with_large"), F.round(F.avg("token_count"), 6).alias("avg_tokens"))


def embedding_status(documents: DataFrame, chunks: DataFrame, is_stale, k: int = 50) -> DataFrame:
    """The first k documents with their chunks counted and whether they need an update."""
    n = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return documents.orderBy("id").limit(k).join(n, "id", "left").select("id", is_stale.alias("needs_update"), F.coalesce("n", F.lit(0)).alias("chunk_count"))


def section_rollup(sections: DataFrame, by: str = "page_id") -> DataFrame:
    """Sections of each page, depth of their tree (two at most) and words."""
    return sections.groupBy(by).agg(F.count(F.lit(1)).alias("total_sections"), (1 + F.max(F.col("parent_id").isNotNull().cast("int"))).alias("max_depth"), F.sum("words").alias("word_count"))


def cache_stats(queries: DataFrame) -> DataFrame:
    return queries.agg(F.count(F.lit(1)).alias("total"), F.sum("hit_count").alias("hits"), F.round(F.avg("hit_count"), 6).alias("avg_hits"), F.count_if(F.col("hit_count") > 1).alias("reused"), percent(F.count_if(F.col("hit_count") > 1), F.count(F.lit(1))).alias("reuse_rate"))


def popular(queries: DataFrame, k: int = 100) -> DataFrame:
    return queries.where("hit_count > 1").orderBy(F.desc("hit_count"), F.desc("last_used"), "query_key").limit(k)


def queue_stats(queue: DataFrame, now) -> DataFrame:
    """Jobs by status: those not completed, and those completed in the last day."""
    recent = (F.col("status") != "completed") | (F.col("processed_at") > now - F.expr("INTERVAL 1 DAY"))
    return queue.where(recent).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def queue_pivot(queue: DataFrame) -> DataFrame:
    q = queue.where("status <> 'completed'")
    return q.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "failed", "completed")], F.count(F.lit(1)).alias("total"))


def crawler_stats(metrics: DataFrame, since) -> DataFrame:
    m = metrics.where(F.col("ts") >= since)
    n = F.count(F.lit(1))
    rate = lambda s: F.format_string("%.1f%%", 100.0 * F.count_if(F.col("status") == s) / F.nullif(n, F.lit(0)))
    return m.agg(n.alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "skipped")], rate("success").alias("success_rate"), rate("failed").alias("failure_rate"), F.round(F.sum(F.coalesce("duration_ms", F.lit(0.0))) / n).cast("long").alias("avg_ms"), F.sum(F.coalesce("chunks_created", F.lit(0))).alias("chunks"))


def failure_rate(metrics: DataFrame, since) -> DataFrame:
    n = F.count(F.lit(1))
    rate = F.coalesce(F.count_if(F.col("status") == "failed") / F.nullif(n, F.lit(0)), F.lit(0.0))
    return metrics.where(F.col("ts") >= since).agg(F.round(rate, 6).alias("failure_rate"), (rate > 0.2).alias("alert"))


def trailing_failure_rate(metrics: DataFrame, by: str = "source_id") -> DataFrame:
    """Share of failures in the hour up to each crawl of a source, itself and its peers included.

    A crawl counts in its own clock hour and, for the crawls of the next one, there too, so that a window's task holds
    two hours of a source and not all of it.
    """
    t = F.col("ts").cast("timestamp").cast("long")
    rows = metrics.select("id", by, t.alias("t"), (F.col("status") == "failed").cast("long").alias("bad"), F.explode(F.array(F.lit(0), F.lit(1))).alias("later"))
    rows = rows.withColumn("hour", F.floor(F.col("t") / HOUR) + F.col("later"))
    w = Window.partitionBy(by, "hour").orderBy("t").rangeBetween(-HOUR, 0)
    rate = F.round(F.sum("bad").over(w) / F.count(F.lit(1)).over(w), 6)
    return rows.withColumn("rate", rate).where("later = 0").select("id", by, "rate")


def daily_stats(metrics: DataFrame, days: int = 7) -> DataFrame:
    d = metrics.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "skipped")], F.round(F.sum("duration_ms"), 2).alias("duration_ms"), F.sum(F.coalesce("chunks_created", F.lit(0))).alias("chunks"))
    return d.orderBy(F.desc("day")).limit(days).orderBy("day")


def dashboard(sources: DataFrame, pages: DataFrame, metrics: DataFrame, since) -> DataFrame:
    """One row of figures since a time; its parts are single rows each. Shares are of crawls, none of none."""
    n = F.count(F.lit(1))
    share = lambda s: F.coalesce(F.round(100.0 * F.count_if(F.col("status") == s) / F.nullif(n, F.lit(0)), 1), F.lit(0.0))
    m = metrics.where(F.col("ts") >= since).agg(n.alias("crawls"), share("success").alias("success_rate"), F.coalesce(F.sum("chunks_created"), F.lit(0)).alias("chunks"), F.coalesce(F.round(F.sum(F.coalesce("duration_ms", F.lit(0.0))) / F.nullif(n, F.lit(0))), F.lit(0)).cast("long").alias("avg_ms"), F.count_if(F.col("status") == "failed").alias("failed"), share("failed").alias("failed_rate"))
    return sources.agg(n.alias("sources"), F.count_if("is_active").alias("active_sources")).crossJoin(pages.agg(n.alias("pages"))).crossJoin(m)


def page_counts(sources: DataFrame, pages: DataFrame) -> DataFrame:
    n = pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return sources.join(n, "source_id", "left").select("source_id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("pages"))


def recent(df: DataFrame, time: str, key: str, k: int) -> DataFrame:
    """Newest first, nulls before all."""
    return df.orderBy(F.col(time).desc_nulls_first(), key).limit(k)


def page_of(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)
