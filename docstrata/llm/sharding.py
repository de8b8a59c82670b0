"""Byte-bounded shards by extendible hashing, in DataFrame functions only.

A directory is indexed by the first bits of a document's hash. Only buckets over the byte limit split on another bit;
all others stay as they are, so a later load moves nothing but the buckets it overfills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, lookup_join, pin

BITS = 32
#: Directory bits beyond those an even split needs, at first; more are added while a bucket is still too large.
SPARE_BITS = 4
#: Production limit of the query: small, so that the tables given have many shards.
LIMIT = 4_000_000


def _hash(id_col: str):
    """The first 32 bits of the id's MD5, as a long: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def directory(sizes: DataFrame, limit: int) -> tuple[int, DataFrame]:
    """(directory bits, slot -> depth, bucket, bytes) from rows (h, bytes) of one hash each or of partial sums."""
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    bits = min(BITS, max(0, int(total // max(limit, 1)).bit_length()) + SPARE_BITS)
    while True:
        slots = sizes.groupBy(F.shiftright("h", BITS - bits).alias("slot")).agg(F.sum("bytes").alias("bytes"))
        slots = pin(slots)
        if bits == BITS or slots.where(F.col("bytes") > limit).isEmpty():
            break
        bits = min(BITS, bits + 4)
    level = F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda d: F.struct(d.alias("depth"), F.call_function("shiftright", F.col("slot"), F.lit(bits) - d).alias("bucket")))
    up = slots.select("bytes", F.explode(level).alias("b")).groupBy("b.depth", "b.bucket").agg(F.sum("bytes").alias("bytes"))
    up = pin(up)
    parent = up.select((F.col("depth") + 1).alias("depth"), "bucket", F.col("bytes").alias("above"))
    at = up.withColumn("above_bucket", F.shiftright("bucket", 1))
    leaf = at.join(parent.withColumnRenamed("bucket", "above_bucket"), ["depth", "above_bucket"], "left")
    leaf = leaf.where(((F.col("bytes") <= limit) | (F.col("depth") == bits)) & (F.col("above").isNull() | (F.col("above") > limit))).select("depth", "bucket", "bytes")
    # Every slot that has documents points to its leaf; empty slots of a deep directory are never listed.
    below = slots.select("slot", F.explode(level).alias("b")).select("slot", "b.depth", "b.bucket")
    return bits, below.join(leaf, ["depth", "bucket"]).select("depth", "bucket", "bytes", "slot")


def shard(docs: DataFrame, limit: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a last column more, a struct `shard` (`shard_2` and so on if docs has that name): depth, bucket (the
    hash's first depth bits), bytes (of the shard), oversize.

    A document's size is its text's UTF-8 bytes (null: 0). Shards hold at most limit bytes; one that cannot be split
    further, because its rows share one id or one text exceeds the limit, is marked oversize. Null ids hash as the
    empty string. Rows of one id go together. An empty table gives no rows; other columns pass through.
    """
    sized = docs.select(_hash(id_col).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    sizes = pin(sized.groupBy("h").agg(F.sum("bytes").alias("bytes")))
    bits, table = directory(sizes, limit)
    slot, out = free_name(docs.columns, "slot"), free_name(docs.columns, "shard")
    table = pin(table.select(F.col("slot").alias(slot), F.struct(F.col("depth").cast("int").alias("depth"), "bucket", "bytes", (F.col("bytes") > limit).alias("oversize")).alias(out)))
    return lookup_join(docs.withColumn(slot, F.shiftright(_hash(id_col), BITS - bits)), table, slot, "left").select(*docs.columns, out)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard(docs, LIMIT)
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("doc_bytes"), F.col("shard.depth").alias("depth"), F.col("shard.bucket").alias("bucket"), F.col("shard.bytes").alias("shard_bytes"))


OP8_SQL = f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS doc_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM documents),
x AS (SELECT CAST(k AS INTEGER) AS depth, h >> (32 - CAST(k AS INTEGER)) AS bucket, doc_id, doc_bytes FROM d, range(0, 33) t(k)),
s AS (SELECT depth, bucket, CAST(sum(doc_bytes) AS BIGINT) AS shard_bytes, max(h) <> min(h) AS apart FROM (SELECT x.*, h FROM x JOIN d USING (doc_id)) GROUP BY ALL),
f AS (SELECT x.*, shard_bytes, row_number() OVER (PARTITION BY doc_id ORDER BY (shard_bytes > {LIMIT}), depth) AS rn FROM x JOIN s USING (depth, bucket))
SELECT doc_id, doc_bytes, depth, bucket, shard_bytes FROM f WHERE rn = 1
"""
