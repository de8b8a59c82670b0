"""Shared pieces of the training-data operators: durable cuts, sized lookups, word hashing, components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows, and bytes of them, of a lookup side that is sent to every executor; larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000
#: Bytes of a row group of the tables written between steps: bounds what a writing task holds.
ROW_GROUP = 32 << 20
#: Entries kept by a worker's word caches before they are emptied.
CACHE_ENTRIES = 150_000
#: Odd multipliers that order the words of a shingle.
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """A folder that every executor reaches: spark.checkpoint.dir. Where it is unset a local master (tests) gets a
    temporary one; on a cluster that is an error, since executors do not share their local folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="docstrata-")
        atexit.register(shutil.rmtree, base, True)
        spark.sparkContext.setCheckpointDir(base)
    return base


#: Folders of this driver's tables, by session, which go when the driver ends.
_written: dict[SparkSession, list[str]] = {}


def pin(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors.

    The table goes with unpin(), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    _written.setdefault(spark, []).append(path)
    if partitions:
        df = df.coalesce(partitions)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pinned_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    _written[spark].remove(path)


def unpin(*tables: DataFrame) -> None:
    """Delete pinned tables that no result reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._pinned_at)


@atexit.register
def _clean() -> None:
    for spark, paths in _written.items():
        if spark.sparkContext._jsc is not None:  # else the session was stopped, and its tables stay
            for path in list(paths):
                _delete(spark, path)


def free_name(taken: list[str], name: str) -> str:
    """name, or name with the first number from 2 on that makes it no column of taken (case is ignored)."""
    low = {c.lower() for c in taken}
    return next(x for x in (name, *(f"{name}_{n}" for n in range(2, len(low) + 3))) if x.lower() not in low)


def release(spark: SparkSession) -> None:
    """Let the driver drop shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _width(table: DataFrame):
    """Bytes of a row: 8 of a plain value, else what the value holds."""
    def of(c, t):
        if isinstance(t, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(t, T.ArrayType):
            if isinstance(t.elementType, (T.NumericType, T.BooleanType)):
                return 8 * F.coalesce(F.size(c), F.lit(0))
            return F.aggregate(F.coalesce(c, F.array()), F.lit(0), lambda s, x: (s + of(x, t.elementType)).cast("int"))
        if isinstance(t, T.StructType):
            return sum((F.coalesce(of(c[f.name], f.dataType), F.lit(0)) for f in t.fields), F.lit(0))
        return F.lit(8)

    return sum((of(F.col(f.name), f.dataType) for f in table.schema.fields), F.lit(0)).cast("long")


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a pinned table has no more rows and bytes than the bounds of a broadcast, by counting them."""
    n, b = table.select(_width(table).alias("w")).limit(rows + 1).agg(F.count(F.lit(1)), F.sum("w")).first()
    return n <= rows and (b or 0) <= size


def lookup_join(left: DataFrame, table: DataFrame, on, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table of unique keys. It is broadcast only if its rows and bytes are counted to be few; else both
    sides are shuffled and adaptive execution splits hot keys. The table must be cheap to count (pinned)."""
    small = limit > 0 and is_small(table, limit)
    return left.join(F.broadcast(table) if small else table.hint("merge"), on, how)


def arrow_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the rows, and so the memory, of one batch of whole texts handed to Python."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Return a worker's freed memory to the system, which reused workers would else hold for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # glibc only
        trim(0)


class WordHash(dict):
    """word (bytes) -> 64-bit hash, the same in every process; emptied when it has CACHE_ENTRIES."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles at each position; of the whole sequence if it has fewer words; none for none."""
    n = len(w)
    if n == 0:
        return w
    k = min(k, n)
    with np.errstate(over="ignore"):
        mult = _MULT[:k] if k <= len(_MULT) else np.power(_MULT[0], np.arange(1, k + 1, dtype=np.uint64))
        out = np.full(n - k + 1, np.uint64(k))
        for j in range(k):
            out += w[j : n - k + 1 + j] * mult[j]
        return mix(out)


def byte_alphabet() -> dict[str, int]:
    """The byte each printable character stands for in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + n): b for n, b in enumerate(rest)}


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with component the smallest node reachable, from edges (a, b) of longs.

    Alternates large-star and small-star steps until no edge changes, so the rounds grow with the logarithm of
    the nodes. Nodes without edges do not appear. Null ends and self loops are dropped; an empty input gives none.
    """
    e = pin(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        n, check = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if n == 0 or (n, check) == seen:
            break
        seen = (n, check)
        send = F.broadcast if 2 * n <= BROADCAST_ROWS else (lambda x: x)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(send(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(send(down), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        e, old = pin(small.where("u <> v").distinct()), e
        unpin(old)
    heads = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return heads.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
