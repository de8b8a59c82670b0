"""Removal of long passages that an earlier document already has, by fixed-block anchors.

Every document is cut into non-overlapping anchor blocks of half a window, so that any repeated window contains a
whole block of its earlier holder. All rolling windows of the block's length probe the blocks; both meet in hash
buckets. Hits are extended, word by word, to the windows around them, and of each such window the smallest holder is
found; runs of windows with an earlier holder are the maximal repeats that are removed. What travels is packed
hashes and places, never texts, and per hash at most one document of each batch, so that a passage in a third of all
documents costs one entry a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WordHash, arrow_batches, free_name, give_back, lookup_join, mix, pin, release, word_hashes

#: Words hashed together in one batch of a task, and words a bucket receives.
BATCH_WORDS, BUCKET_WORDS = 250_000, 500_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _rolling(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, for positions 0 .. len(w) - k."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = w[:n].copy()
        for j in range(1, k):
            out *= _PRIME
            out += w[j : n + j]
        return mix(out)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of unsigned integers by significance, so that the shuffle's compression finds the empty ones."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(b: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, n).T.copy().view(kind).ravel()


class _Batch:
    """Documents hashed together: ids, keys, word hashes, and spans known before."""

    def __init__(self) -> None:
        self.ids, self.keys, self.parts, self.spans, self.words = [], [], [], [], 0

    def add(self, doc: int, key: int, w: np.ndarray, spans=None) -> None:
        self.ids.append(doc), self.keys.append(key), self.parts.append(w), self.spans.append(spans)
        self.words += len(w)

    def close(self) -> None:
        lengths = [len(w) for w in self.parts]
        self.starts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        self.doc_of = np.repeat(np.arange(len(lengths)), lengths)
        self.long_ids = np.array(self.ids, np.int64)
        self.head = np.concatenate((self.long_ids, np.array(self.keys, np.int64), self.starts))
        self.name = xxhash.xxh3_64_intdigest(self.head.tobytes()) - 2**63


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.empty(0, np.int64)


def _repeat(x: np.ndarray, run: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(x, np.diff(np.append(run, n)))


#: batch: name; kind: 0 the batch's head, 1 places decided in the batch, 2 entries to decide.
_WIRE = "bucket int, batch long, kind int, blob binary"


def _wire(batch: _Batch, decided: np.ndarray, h: np.ndarray, places: np.ndarray, extra: np.ndarray | None, buckets: int, kind) -> pa.RecordBatch:
    home = batch.name % buckets
    rows = [(home, 0, batch.head.tobytes()), (home, 1, decided.astype(np.uint32).tobytes())]
    bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((places, bucket))
    bucket, h, places = bucket[order], h[order].astype(kind), places[order].astype(np.uint32)
    extra = extra[order] if extra is not None else None
    cut = _runs(bucket)
    for a, b in zip(cut, np.append(cut[1:], len(bucket))[: len(cut)], strict=True):
        blob = h[a:b].tobytes() + _planes(places[a:b]) + (_planes(extra[a:b].view(np.uint64)) if extra is not None else b"")
        rows.append((int(bucket[a]), 2, blob))
    b, k, x = zip(*rows, strict=True)
    return pa.record_batch([pa.array(b, pa.int32()), pa.array([batch.name] * len(rows), pa.int64()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], ["bucket", "batch", "kind", "blob"])


def _exchange(flush: Callable, texts: DataFrame, resolve: Callable, kind, extra: bool, back: int) -> DataFrame:
    """(doc, tkey, spans): batches of documents send entries to the buckets of their hashes, buckets decide which
    places count, and each batch turns its places p into spans p - back .. p of its documents."""
    width = np.dtype(kind).itemsize + 4 + 8 * extra

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, batch = WordHash(), _Batch()
        for b in batches:
            spans = b.column(3) if b.num_columns > 3 else None
            for i in range(b.num_rows):
                w = b.column(2)[i].as_py().encode("utf-8", "surrogatepass").split()
                batch.add(b.column(0)[i].as_py(), b.column(1)[i].as_py(), word_hashes(w, cache), spans[i].values.to_numpy() if spans is not None else None)
                if batch.words >= BATCH_WORDS:
                    batch.close()
                    yield flush(batch)
                    batch = _Batch()
        if batch.words:
            batch.close()
            yield flush(batch)
        cache.clear()
        del batch
        give_back()

    def at_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf.loc[pdf["kind"] < 2, ["batch", "kind", "blob"]]
        new = pdf.loc[pdf["kind"] == 2]
        counts = [len(x) // width for x in new["blob"]]
        name = np.repeat(new["batch"].to_numpy(np.int64), counts)
        h, place, more = [], [], []
        for x, n in zip(new["blob"], counts, strict=True):
            at = np.dtype(kind).itemsize * n
            h.append(np.frombuffer(x[:at], kind))
            place.append(_unplanes(x[at : at + 4 * n], n, np.uint32))
            if extra:
                more.append(_unplanes(x[at + 4 * n :], n, np.uint64).view(np.int64))
        if not h:
            return known
        h, place = np.concatenate(h), np.concatenate(place)
        order = np.argsort(h, kind="stable")
        h, place, name = h[order], place[order], name[order]
        hit = resolve(h, _runs(h), place, np.concatenate(more)[order] if extra else name)
        name, place = name[hit], place[hit] & np.uint32(0x7FFFFFFF)
        order = np.argsort(name, kind="stable")
        name, place = name[order], place[order]
        cut = _runs(name)
        del h, order, hit
        give_back()
        found = pd.DataFrame({"batch": name[cut], "kind": 1, "blob": pd.Series([x.tobytes() for x in np.split(place, cut[1:])] if len(cut) else [], dtype=object)})
        return pd.concat([known, found.astype({"kind": "int32"})], ignore_index=True)

    def at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        head = np.frombuffer(pdf.loc[pdf["kind"] == 0, "blob"].iloc[0], np.int64)
        docs = (len(head) - 1) // 3
        ids, keys, starts = head[:docs], head[docs : 2 * docs], head[2 * docs :]
        places = np.unique(np.frombuffer(b"".join(pdf.loc[pdf["kind"] == 1, "blob"]), np.uint32)).astype(np.int64)
        if not len(places):
            return pd.DataFrame({"doc": np.empty(0, np.int64), "tkey": np.empty(0, np.int64), "spans": pd.Series([], dtype=object)})
        d = np.searchsorted(starts, places, side="right") - 1
        p = places - starts[d]
        first = np.maximum(p - back, 0)
        fresh = np.concatenate(([True], (d[1:] != d[:-1]) | (first[1:] > p[:-1] + 1)))
        cut = np.flatnonzero(fresh)
        last = np.append(cut[1:], len(p)) - 1
        packed, who = first[cut] << 32 | p[last], d[cut]
        split = _runs(who)
        return pd.DataFrame({"doc": ids[who[split]], "tkey": keys[who[split]], "spans": pd.Series(np.split(packed, split[1:]), dtype=object)})

    decided = texts.mapInArrow(emit, _WIRE).groupBy("bucket").applyInPandas(at_bucket, "batch long, kind int, blob binary")
    out = decided.groupBy("batch").applyInPandas(at_home, "doc long, tkey long, spans array<long>")
    # Rows of one document may lie in several batches if the document has repeated rows.
    return out.groupBy("doc", "tkey").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _anchor_flush(window: int, anchor: int, buckets: int) -> Callable:
    def flush(batch: _Batch) -> pa.RecordBatch:
        doc_of, n = batch.doc_of, len(batch.doc_of)
        h = _rolling(np.concatenate(batch.parts), anchor)
        ok = np.flatnonzero((doc_of[: len(h)] == doc_of[anchor - 1 : n]) & (np.diff(batch.starts)[doc_of[: len(h)]] >= window))
        order = np.argsort(h[ok], kind="stable")
        places = ok[order]
        h = h[places]
        run = _runs(h)
        block = (places - batch.starts[doc_of[places]]) % anchor == 0
        if not len(h):
            return _wire(batch, places, h, places, None, buckets, np.uint32)
        ids = batch.long_ids[doc_of[places]]
        several = np.maximum.reduceat(ids, run) != np.minimum.reduceat(ids, run)
        in_several = _repeat(several, run, len(h))
        # A hash of several documents here is a hit for each; one entry, a block if there is one, stands for them.
        keep = ~in_several
        keep[run[several]] = True
        sent = places | (np.where(keep & in_several, _repeat(np.logical_or.reduceat(block, run), run, len(h)), block).astype(np.int64) << 31)
        return _wire(batch, places[in_several], h[keep], sent[keep], None, buckets, np.uint32)

    return flush


def _anchor_hits(h: np.ndarray, run: np.ndarray, place: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Entries of a hash that several batches have (in a batch, one document has it) and a block among them."""
    hit = (np.maximum.reduceat(name, run) != np.minimum.reduceat(name, run)) & np.logical_or.reduceat(place >> np.uint32(31) == 1, run)
    return _repeat(hit, run, len(h))


def _mask(spans, n: int) -> np.ndarray:
    """True at the places 0 .. n - 1 that the packed spans cover."""
    edge = np.zeros(n + 1, np.int64)
    spans = np.asarray(spans, np.int64)
    np.add.at(edge, np.minimum(spans >> 32, n), 1)
    np.add.at(edge, np.minimum((spans & 0xFFFFFFFF) + 1, n), -1)
    return np.cumsum(edge[:n]) > 0


def _window_flush(window: int, buckets: int) -> Callable:
    def flush(batch: _Batch) -> pa.RecordBatch:
        hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for start, w, spans in zip(batch.starts[:-1], batch.parts, batch.spans, strict=True):
            near = np.flatnonzero(_mask(spans, max(len(w) - window + 1, 0)))
            cut = np.flatnonzero(np.concatenate(([True], np.diff(near) != 1))) if len(near) else near
            for a, b in zip(near[cut], near[np.append(cut[1:], len(near)) - 1] if len(near) else near, strict=True):
                hashes.append(_rolling(w[a : b + window], window))
                places.append(np.arange(a, b + 1) + start)
        h, p = np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        h, p = h[order], p[order]
        ids, run = batch.long_ids[batch.doc_of[p]], _runs(h)
        first = _repeat(np.minimum.reduceat(ids, run), run, len(h)) if len(h) else ids
        own = ids == first
        return _wire(batch, p[~own], h[own], p[own], ids[own], buckets, np.uint64)

    return flush


def _later(h: np.ndarray, run: np.ndarray, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Entries whose window an earlier document has."""
    return doc > _repeat(np.minimum.reduceat(doc, run), run, len(h))


def _with_spans(left: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Join on document and key; the spans are broadcast only if their number is counted to be small."""
    keys, col = spans.columns[:2], spans.columns[2]
    total = spans.agg(F.sum(F.size(col))).first()[0] or 0
    return lookup_join(left, spans, keys, how, BROADCAST_ROWS if total <= 2 * BROADCAST_ROWS else 0)


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a last column more, a struct `repeats` (`repeats_2` and so on if docs has that name): n_words,
    n_removed, kept (the words left, one space between).

    Words are runs without ASCII white space, unchanged. A word is removed if some window of `window` consecutive
    words around it also begins in a document with a smaller id; windows are judged on the input. Null texts have no
    words and keep a null text; rows with a null id are neither sources nor changed; rows of one id are not earlier
    than each other. Texts shorter than a window are unchanged. Repeated rows each get a row; an empty table gives no
    rows. Other columns pass through, whatever their names.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    anchor = window // 2
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // 6 // BUCKET_WORDS)
    # A hit at p makes candidates of the windows that begin at p - (window - anchor) .. p and so contain it.
    hits = pin(_exchange(_anchor_flush(window, anchor, buckets), texts, _anchor_hits, np.uint32, False, window - anchor))
    release(spark)
    near = _with_spans(texts, hits, "inner").select("doc", "tkey", "text", "spans")
    gone = pin(_exchange(_window_flush(window, buckets), near, _later, np.uint64, True, 0))
    release(spark)

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        n_words, n_removed, kept = [], [], []
        for t, s in zip(text, spans, strict=True):
            words = t.encode("utf-8", "surrogatepass").split() if t is not None else []
            n_words.append(len(words))
            left = words
            if s is not None and len(s):
                covered = np.zeros(len(words) + window, np.int64)
                begin = np.flatnonzero(_mask(s, len(words)))
                np.add.at(covered, begin, 1)
                np.add.at(covered, begin + window, -1)
                stay = np.cumsum(covered)[: len(words)] == 0
                left = [w for w, ok in zip(words, stay, strict=True) if ok]
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode("utf-8", "surrogatepass") if t is not None else None)
        return pd.DataFrame({"n_words": n_words, "n_removed": n_removed, "kept": kept})

    # A filter on its result would else be pushed below, and the words be cut twice, by two workers a task.
    cut = cut.asNondeterministic()
    doc, key, at, out = (free_name(docs.columns, x) for x in ("doc", "tkey", "spans", "repeats"))
    keyed = docs.withColumn(doc, F.col(id_col).cast("long")).withColumn(key, F.xxhash64(text_col))
    spans = gone.select(F.col("doc").alias(doc), F.col("tkey").alias(key), F.col("spans").alias(at))
    return _with_spans(keyed, spans, "left").select(*docs.columns, cut(F.col(text_col), F.col(at)).alias(out))


def dedup_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """The documents without passages of `window` words or more that an earlier one has, with the columns they had.

    Changed texts are their kept words with one space between and n_chars follows; unchanged ones stay as they are.
    Documents that lose all their words go. Nulls, repeated rows and empty tables are as for remove_repeats().
    """
    out = remove_repeats(docs, window)
    got = F.col(out.columns[-1])
    changed = got["n_removed"] > 0
    new = {"text": F.when(changed, got["kept"]).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(got["kept"])).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.where(~changed | (got["n_removed"] < got["n_words"])).select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", F.col("repeats.n_words").alias("n_words"), F.col("repeats.n_removed").alias("n_removed"), F.sha2(F.coalesce("repeats.kept", F.lit("")), 256).alias("kept_sha256"))
