"""MinHash near-duplicate detection with sequential Bayesian verification.

Banded MinHash proposes candidate pairs; signature batches are compared one after another and a pair is dropped as
soon as its posterior probability of reaching the threshold falls under the miss probability; survivors are checked
on their full shingle sets. Groups never become all-pairs rows: equal sets collapse first, each bucket is compared
with its leaders, and where a bucket still spans several components, the members outside its largest one meet the
others again, in bounded blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, arrow_batches, connected_components, free_name, give_back, lookup_join, mix, pin, release, shingles, unpin, word_hashes

ROWS_PER_BAND = 5
#: Probability that banding proposes no common bucket for a pair exactly at the threshold.
BAND_MISS = 1e-7
#: Posterior probability of reaching the threshold under which a pair is dropped.
POSTERIOR_MISS = 1e-7
#: Most members, and bytes of their full sets, on either side of a block of the last comparison (on average).
BLOCK, BLOCK_BYTES = 512, 4_000_000


def bands_for(threshold: float, rows: int = ROWS_PER_BAND, miss: float = BAND_MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - threshold**rows)))


def bayes_floor(n_hashes: int, threshold: float, batch: int, miss: float = POSTERIOR_MISS) -> list[tuple[int, int]]:
    """(hashes compared, fewest equal ones to go on) after each batch.

    Signatures keep 8 bits of each minimum, so equal ones have probability q = s + (1 - s) / 256. With a uniform
    prior the posterior of q after m of n is Beta(m + 1, n - m + 1), and P(q >= t) = P(Binomial(n + 1, t) <= m).
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in [*range(batch, n_hashes, batch), n_hashes]:
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _signatures(n_hashes: int, bands: int, k: int):
    rng = np.random.default_rng(20240131)
    mul = (rng.integers(0, 2**32, n_hashes, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    add = rng.integers(0, 2**32, n_hashes, dtype=np.uint64).astype(np.uint32)
    weight = rng.integers(0, 2**63, (1, n_hashes // bands), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            ids, counts, digests, sigs, keys = batch.column(0), [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                s = np.unique(shingles(word_hashes(_words(text), cache), k)) if text else np.empty(0, np.uint64)
                counts.append(len(s))
                if not len(s):
                    digests.append(None), sigs.append(None), keys.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                h, low = (s >> np.uint64(32)).astype(np.uint32), None
                for i in range(0, len(h), 512):
                    x = h[i : i + 512, None] * mul
                    x += add
                    m = x.min(axis=0)
                    low = m if low is None else np.minimum(low, m)
                sigs.append((low >> np.uint32(7)).astype(np.uint8).tobytes())
                b = (low.astype(np.uint64).reshape(bands, -1) + np.uint64(1)) * weight
                keys.append(mix(b.sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
            yield pa.record_batch([ids, pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "sig", "bands"])
        cache.clear()
        give_back()

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            sets = [np.unique(shingles(word_hashes(_words(t.as_py()), cache), k)).tobytes() for t in batch.column(1)]
            digests = [xxhash.xxh3_128_digest(x) for x in sets]
            yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "digest", "shset"])
        cache.clear()
        give_back()

    return run


def _verify(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, floor: list[tuple[int, int]], num: int, den: int) -> DataFrame:
    """Pairs (a, b) that pass the sequential test and then den * |A & B| >= num * |A | B| on their full sets."""

    @F.pandas_udf("boolean")
    def likely(x: pd.Series, y: pd.Series) -> pd.Series:
        ok = np.ones(len(x), bool)
        if not len(x):
            return pd.Series(ok)
        a = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
        b = np.frombuffer(b"".join(y), np.uint8).reshape(len(x), -1)
        live, same, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
        for n, least in floor:
            same[live] += (a[live, at:n] == b[live, at:n]).sum(axis=1)
            at = n
            live = live[same[live] >= least]
        ok[:] = False
        ok[live] = True
        return pd.Series(ok)

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            a, b = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            lo, hi = min(len(a), len(b)), max(len(a), len(b))
            if den * lo < num * hi:  # the sizes alone rule it out
                out.append(False)
                continue
            inter = len(a) + len(b) - len(np.union1d(a, b))
            out.append(den * inter >= num * (len(a) + len(b) - inter))
        give_back()
        return pd.Series(out, dtype=bool)

    def with_both(df: DataFrame, table: DataFrame, col: str) -> DataFrame:
        df = df.join(table.select(F.col("id").alias("a"), F.col(col).alias("x")), "a")
        return df.join(table.select(F.col("id").alias("b"), F.col(col).alias("y")), "b")

    close = pin(with_both(pairs, sigs, "sig").where(likely("x", "y")).select("a", "b"))
    return pin(with_both(close, sets, "shset").where(linked("x", "y")).select("a", "b"))


def _class_ids(classes: DataFrame, several: bool) -> DataFrame:
    """(digest, set_id, id): id is a different long for each class; set_id itself unless several classes share one."""
    if not several:
        return classes.withColumn("id", F.col("set_id"))
    first = F.col("digest") == F.min("digest").over(Window.partitionBy("set_id"))
    salt = 0
    while True:
        out = pin(classes.withColumn("id", F.when(first, F.col("set_id")).otherwise(F.xxhash64("digest", F.lit(salt)))))
        if out.groupBy("id").count().where("count > 1").isEmpty():
            return out
        salt += 1


def _blocks(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, as (bucket, id, component, blk, other, outside).

    Each member is on one side of the blocks of its bucket, and once more on the other side if it is outside the
    bucket's largest component: only pairs with such an end can link components. A bucket that has all but collapsed
    sends each member about once; both sides are dealt by hash into parts of bounded size.
    """
    placed = lookup_join(members.select("bucket", "id", "n_shingles"), comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = pin(placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), (8 * F.sum("n_shingles")).alias("bytes")))
    size = lambda n, b: F.ceil(F.greatest(n / BLOCK, b / BLOCK_BYTES)).cast("int")
    most = F.max(F.struct("n", "component", "bytes"))
    per = parts.groupBy("bucket").agg(most.alias("most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("most.n < n")
    per = pin(per.select("bucket", F.col("most.component").alias("largest"), size(F.col("n"), F.col("bytes")).alias("blocks"), size(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("others")))
    left = lookup_join(placed, per, "bucket", "inner")
    deal = lambda n: F.expr(f"sequence(0, {n} - 1)")
    inner = left.select("bucket", "id", "component", F.expr("cast(pmod(xxhash64(id), blocks) as int)").alias("blk"), F.explode(deal("others")).alias("other"), F.lit(False).alias("outside"))
    outer = left.where("component <> largest").select("bucket", "id", "component", F.explode(deal("blocks")).alias("blk"), F.expr("cast(pmod(xxhash64(id), others) as int)").alias("other"), F.lit(True).alias("outside"))
    return inner.union(outer)


def _cross(floor: list[tuple[int, int]], num: int, den: int):
    """Links between components of one block: signature batches first, then the full sets. Components that a link
    joins count as one from there on, so a block gives fewer links than it has components."""

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        outside = pdf["outside"].to_numpy()
        ids, comp = pdf["id"].to_numpy(), pdf["component"].to_numpy().copy()
        inner = np.flatnonzero(~outside)
        if outside.any() and len(inner):
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
            keys = np.array(pdf["bands"].tolist(), np.int64)
            own = int(np.argmax((keys == pdf["bucket"].iloc[0]).all(axis=0)))
            sets = [np.frombuffer(x, np.uint64) for x in pdf["shset"]]
            sizes = np.array([len(x) for x in sets])
            both = np.isin(ids[inner], ids[outside])  # a pair of two outsiders is compared from its smaller end only
            for i in np.flatnonzero(outside):
                j = inner[(comp[inner] != comp[i]) & (~both | (ids[inner] > ids[i]))]
                j = j[den * np.minimum(sizes[j], sizes[i]) >= num * np.maximum(sizes[j], sizes[i])]
                for n, need in floor:
                    j = j[(sig[j, :n] == sig[i, :n]).sum(axis=1) >= need]
                    if not len(j):
                        break
                if len(j):
                    j = j[~(keys[j, :own] == keys[i, :own]).any(axis=1)]  # an earlier bucket has the others
                if not len(j):
                    continue
                flat, mine = np.concatenate([sets[x] for x in j]), sets[i]
                hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                inter = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(sizes[j])[:-1])), dtype=np.int64)
                j = j[den * inter >= num * (sizes[j] + sizes[i] - inter)]
                if len(j):
                    joined, at = np.unique(comp[j], return_index=True)
                    found += [(ids[i], ids[x]) for x in j[at]]
                    comp[np.isin(comp, joined)] = comp[i]
            del sets, sig, keys
            give_back()
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    return cross


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept, set_id (smallest doc_id with an equal set).

    A document's set is its distinct k-word shingles after lower-casing A-Z, words being runs without ASCII white
    space; documents of fewer words have one shingle, the whole sequence. Documents are linked if den * |A & B| >=
    num * |A | B|; component_id is the smallest doc_id reachable. Null or wordless texts have the empty set and link
    with nothing. Rows with a null id keep a null component and are kept. Repeated rows of one id each get a row, and
    rows of one id with different texts are judged each by its own text. Other columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    t = num / den
    bands = bands_for(t)
    n_hashes = bands * ROWS_PER_BAND
    floor = bayes_floor(n_hashes, t, 4 * ROWS_PER_BAND)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = pin(texts.mapInArrow(_signatures(n_hashes, bands, k), "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"))
    classes = pin(rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("set_id")))
    repeats = not rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    ids = _class_ids(classes, repeats)
    reps = lookup_join(rows, ids.select("digest", F.col("set_id").alias("doc_id"), "id"), ["digest", "doc_id"], "inner")
    reps = pin((reps.dropDuplicates(["id"]) if repeats else reps).select("id", "digest", "doc_id", "n_shingles", "sig", "bands"))
    release(spark)

    entries = reps.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = pin(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).where("n > 1"))
    members = pin(lookup_join(entries, shared, "bucket", "inner"))
    unpin(shared)
    release(spark)
    wanted = pin(lookup_join(reps.select("id", "digest", "doc_id"), pin(members.select("id").distinct()), "id", "left_semi"))
    sigs = pin(lookup_join(reps.select("id", "sig"), wanted.select("id"), "id", "left_semi"))
    one_id = wanted.select("doc_id").distinct() if repeats else wanted.select("doc_id")
    sets = lookup_join(texts.where("text is not null and doc_id is not null"), one_id, "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, digest binary, shset binary")
    if repeats:
        sets = lookup_join(sets, wanted.select("digest", "id"), "digest", "inner").dropDuplicates(["id"])
    sets = pin(sets.select((F.col("id") if repeats else F.col("doc_id")).alias("id"), "shset"))
    release(spark)

    star = members.select(F.explode(F.array(F.struct(F.col("first").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("last").alias("b")))).alias("p")).select("p.a", "p.b").where("a <> b").distinct()
    links = _verify(star, sigs, sets, floor, num, den)
    comps = pin(connected_components(links))
    unpin(links, sigs)

    left = pin(_blocks(members, comps))
    left = left.join(reps.select("id", "sig", "bands").hint("merge"), "id").join(sets, "id")
    more = pin(left.groupBy("bucket", "blk", "other").applyInPandas(_cross(floor, num, den), "a long, b long").distinct())
    as_a = comps.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    as_b = comps.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    bridges = lookup_join(lookup_join(more, as_a, "a"), as_b, "b").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = pin(connected_components(bridges))

    final = lookup_join(ids, comps.withColumnRenamed("node", "id"), "id").withColumn("component", F.coalesce("component", "id"))
    final = lookup_join(final, merged.select(F.col("node").alias("component"), F.col("component").alias("top")), "component")
    final = pin(final.select("digest", "set_id", F.coalesce("top", "component").alias("component")))
    if repeats:  # ids of classes are not all doc_ids then
        least = pin(final.groupBy("component").agg(F.min("set_id").alias("least")))
        final = pin(lookup_join(final, least, "component").select("digest", "set_id", F.col("least").alias("component")))
    unpin(reps, members, sets, more)
    out = lookup_join(rows.select("doc_id", "n_shingles", "digest"), final, "digest")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("set_id", "doc_id").alias("set_id"))


def dedup_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents of which near_duplicates keeps one of each group, with the columns they had, whatever their names.

    An id goes if one of its rows is not kept. Of rows of a kept id with equal texts one stays, whichever; its rows
    with different texts all stay. Rows with a null id stay, as do null and wordless texts; an empty table gives no
    rows.
    """
    verdict = pin(near_duplicates(docs, k, num, den).select("doc_id", "kept"))
    bad = pin(verdict.where("not kept").select("doc_id").distinct())
    repeated = pin(verdict.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    left = lookup_join(docs, bad, "doc_id", "left_anti")
    if repeated.isEmpty():
        return left
    key = free_name(docs.columns, "text_key")
    again = lookup_join(left, repeated, "doc_id", "left_semi").withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key])
    return lookup_join(left, repeated, "doc_id", "left_anti").unionByName(again.select(*docs.columns))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, k=3, num=85, den=100)
