"""Sources and sinks: tables, sitemaps, PDFs by name, batch writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut

SITEMAP = "url array<struct<loc string, lastmod string, changefreq string, priority double>>"
INDEX = "sitemap array<struct<loc string, lastmod string>>"


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def sitemap_entries(xml: DataFrame, col: str = "xml") -> DataFrame:
    """url, lastmod, changefreq, priority (0.5 where absent) of url sets; malformed ones have none."""
    e = F.explode(F.from_xml(F.col(col), SITEMAP, {"mode": "PERMISSIVE"})["url"]).alias("e")
    return xml.select(e).select(F.col("e.loc").alias("url"), F.to_timestamp("e.lastmod").alias("lastmod"), "e.changefreq", F.coalesce("e.priority", F.lit(0.5)).alias("priority")).where("url is not null")


def sitemap_tree(files: DataFrame, roots: list[str], depth: int = 5) -> DataFrame:
    """Entries of the url sets reached from root sitemaps over sitemap indexes; files has (location, xml), and indexes
    whose children are absent are tolerated."""
    at = cut(files.where(F.col("location").isin(roots)))
    found = at
    for _ in range(depth):
        if at.isEmpty():
            break
        child = at.select(F.explode(F.from_xml("xml", INDEX, {"mode": "PERMISSIVE"})["sitemap"]).alias("s")).select(F.col("s.loc").alias("location")).distinct()
        at = cut(files.join(child, "location", "left_semi").join(found.select("location"), "location", "left_anti"))  # each level is parsed once
        found = found.unionByName(at)
    return sitemap_entries(found)


def is_pdf(url, content_type=None):
    """Whether a url names a PDF."""
    hit = F.lower(url).rlike(r"\.pdf($|\?)") | F.contains(F.lower(url), F.lit("content-type=application/pdf"))
    return hit if content_type is None else hit | (content_type == "application/pdf")


def clean_pdf_text(text):
    """One space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"[\f\r]", ""))


def wants_ocr(src, alt):
    """Whether an image is worth reading: of a common format, and without a telling alternative text."""
    told = (F.length(alt) > 10) & ~F.contains(F.lower(alt), F.lit("image"))
    return ~F.coalesce(told, F.lit(False)) & F.lower(src).rlike(r"\.jpg|\.jpeg|\.png|\.gif|\.webp|\.bmp")


def ocr_bucket(confidence):
    """Accepted over 0.6, tagged over 0.3, else dropped."""
    return F.when(confidence > 0.6, "accept").when(confidence > 0.3, "low_confidence").otherwise("drop")


def append(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)
