"""Best-fit packing of tokenised documents by length patterns and non-negative least squares.

The histogram of piece lengths (at most max_tokens numbers, whatever the data's size) is explained as a mix of
patterns of few documents that fill a sequence: repeat counts are fitted by non-negative least squares over coarse
lengths, rounded, and realised with exact lengths; what is left is packed best fit, longest first, still on the
histogram. The plan then tells every piece its place from its length and its rank among pieces of that length, which
is counted in salted groups, so no length is ever gathered in one task.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, byte_alphabet, give_back, lookup_join, pin

MAX_TOKENS = 2048
#: Coarse lengths of the fit.
GRID = 256
#: The pre-tokenizer's words in texts of Latin-1 characters, after lower-casing; other texts go through the tokenizer.
_LATIN = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'(?:s|t|re|ve|m|ll|d)|[^ \t\n\x0b\f\r\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
_OTHER = re.compile(r"[^\t\n\x0b\f\r -~\xa0-\xff]")
#: Words remembered by an encoder: the newer half, and the older half that gives way to it.
WORDS = 220_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """ids of a text. Words of Latin-1 texts are encoded once and remembered; the tokenizer encodes other texts whole."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.cache, self.older = _load(path), {}, {}
        self.model, self.letter = self.tokenizer.model, {b: c for c, b in byte_alphabet().items()}

    def _learn(self, word: str) -> None:
        """A whole pre-tokenized word goes straight to the merges, its bytes written in the vocabulary's letters."""
        spelt = word if word.isascii() else "".join(map(self.letter.__getitem__, word.encode("utf-8")))
        self.cache[word] = struct.pack(f"<{len(t)}I", *t) if (t := [x.id for x in self.model.tokenize(spelt)]) else b""

    def __call__(self, text: str) -> np.ndarray:
        if "<|" in text or _OTHER.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        words = _LATIN.findall(text.lower())
        found = list(map(self.cache.get, words))
        if None in found:
            new = {w for w, f in zip(words, found, strict=True) if f is None}
            if len(self.cache) + len(new) > WORDS // 2:
                self.older, self.cache = self.cache, {}
                new = set(words)
            for w in new:
                known = self.older.get(w)
                if known is None:
                    self._learn(w)
                else:
                    self.cache[w] = known
            found = map(self.cache.__getitem__, words)
        return np.frombuffer(b"".join(found), "<u4")


def _pieces(path: str, max_tokens: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                tokens = np.append(encode(t.as_py() or ""), np.array([0], "<u4")).astype("<u4")
                for n, at in enumerate(range(0, len(tokens), max_tokens)):
                    part = tokens[at : at + max_tokens]
                    doc.append(d.as_py()), piece.append(n), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.tobytes())), ids.append(part.astype(np.int32) if with_ids else None)
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        del encode
        give_back()

    return run


def patterns(grid: int) -> list[tuple[int, ...]]:
    """All multisets of up to three coarse lengths that fill the grid."""
    out = [(grid,)]
    for a in range(grid - 1, (grid + 2) // 3 - 1, -1):
        for b in range(min(a, grid - a), 0, -1):
            c = grid - a - b
            if c == 0:
                out.append((a, b))
            elif c <= b:
                out.append((a, b, c))
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tiny = 1e-9 * (1 + np.abs(b).max(initial=0))
    for _ in range(rounds):
        gain = np.where(passive, -np.inf, a.T @ (b - a @ x))
        j = int(gain.argmax())
        if gain[j] <= tiny:
            break
        passive[j] = True
        while True:
            p = np.flatnonzero(passive)
            q = a[:, p]
            s = np.linalg.solve(q.T @ q + 1e-10 * np.eye(len(p)), q.T @ b)
            if s.min() > 0:
                x[:] = 0
                x[p] = s
                break
            low = s <= 0
            step = np.min(x[p][low] / np.maximum(x[p][low] - s[low], 1e-300))
            x[p] += step * (s - x[p])
            passive[p[x[p] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan(hist: np.ndarray, size: int, grid: int = GRID) -> list[tuple[list[tuple[int, int]], int]]:
    """Groups ([(length, times), ...], sequences) that hold hist[l] pieces of each length l <= size.

    The fit decides how coarse lengths are combined; exact lengths are then taken so that the last document of a
    pattern is the longest that still fits. Work and result are bounded by size and grid, not by the pieces.
    """
    left = hist.astype(np.int64).copy()
    out: list[tuple[list[tuple[int, int]], int]] = []
    if left[size]:
        out.append(([(size, 1)], int(left[size])))
        left[size] = 0
    grid = min(grid, size)
    coarse = np.minimum((np.arange(size + 1) * grid + size // 2) // size, grid)
    coarse[1:] = np.maximum(coarse[1:], 1)
    target = np.bincount(coarse, weights=left, minlength=grid + 1)[1:]
    if left.any():
        shapes = patterns(grid)
        a = np.zeros((grid, len(shapes)))
        for n, shape in enumerate(shapes):
            for c in shape:
                a[c - 1, n] += 1
        weight = (np.arange(1, grid + 1) / grid)[:, None]  # a long piece left over costs most of a sequence
        times = np.rint(nnls(a * weight, target * weight[:, 0])).astype(np.int64)
        bins = [np.flatnonzero(coarse == c) for c in range(grid + 1)]
        step = -(-size // grid)

        def longest(limit: int, low: int) -> int:
            near = np.flatnonzero(left[max(low, 1) : limit + 1])
            return int(near[-1]) + max(low, 1) if len(near) else 0

        for n in sorted(np.flatnonzero(times), key=lambda n: shapes[n], reverse=True):
            shape, want = shapes[n], int(times[n])
            while want > 0 and len(shape) > 1:
                taken: list[int] = []
                for c in shape[:-1]:
                    free = [l for l in bins[c] if left[l] > taken.count(l)]
                    if not free or sum(taken) + free[-1] >= size:
                        break
                    taken.append(int(free[-1]))
                if len(taken) < len(shape) - 1:
                    break
                room = size - sum(taken)
                for l in taken:
                    left[l] -= 1
                last = longest(room, room - 2 * step)
                for l in taken:
                    left[l] += 1
                if not last:
                    break
                taken.append(last)
                counts = {l: taken.count(l) for l in taken}
                t = min(want, *(int(left[l]) // k for l, k in counts.items()))
                if t <= 0:
                    break
                for l, k in counts.items():
                    left[l] -= k * t
                out.append((sorted(counts.items(), reverse=True), t))
                want -= t
    # Residuals: best fit, longest first. open_[s]: groups with s tokens free.
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    free = np.zeros(size + 1, bool)
    for l in range(size, 0, -1):
        n = int(left[l])
        while n:
            room = int(np.argmax(free[l:])) + l
            if not free[room]:
                per = min(size // l, n)
                groups = n // per
                open_.setdefault(size - per * l, []).append(([(l, per)], groups))
                free[size - per * l] = True
                n -= per * groups
                continue
            items, count = open_[room].pop()
            per = min(room // l, n)
            t = min(count, n // per)
            if t < count:
                open_[room].append((items, count - t))
            free[room] = bool(open_[room])
            open_.setdefault(room - per * l, []).append(([*items, (l, per)], t))
            free[room - per * l] = True
            n -= per * t
    return out + [g for groups in open_.values() for g in groups]


def pack(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    A document is its tokens and the id 0; only documents over max_tokens are cut, and only there. Null and empty
    texts are the id 0 alone. Rows with a null id and repeated rows are packed like others. An empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    path = path or tokenizer_path()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = pin(texts.mapInArrow(_pieces(path, max_tokens, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"))
    salts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32), {salts})"))
    cells = pin(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    hist = np.zeros(max_tokens + 1, np.int64)
    for l, n in cells.groupBy("length").agg(F.sum("n")).collect():  # at most max_tokens rows
        hist[l] = n
    keys, seqs, times, offsets, ends, base = [], [], [], [], np.zeros(max_tokens + 1, np.int64), 0
    for items, count in plan(hist, max_tokens):
        at = 0
        for l, per in items:
            keys.append(l << 44 | int(ends[l])), seqs.append(base), times.append(per), offsets.append(at)
            ends[l] += per * count
            at += l * per
        base += count
    order = np.argsort(np.array(keys, np.int64))
    table = spark.sparkContext.broadcast(tuple(np.array(x, np.int64)[order] for x in (keys, seqs, times, offsets)))  # bounded by the plan

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, seq, per, off = table.value
        want = length.to_numpy(np.int64) << 44 | rank.to_numpy(np.int64)
        i = np.searchsorted(key, want, side="right") - 1
        k = want - key[i]
        return pd.DataFrame({"sequence_id": seq[i] + k // np.maximum(per[i], 1), "offset": off[i] + k % np.maximum(per[i], 1) * length.to_numpy(np.int64)})

    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    before = cells.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = lookup_join(salted.withColumn("nth", rank), pin(before), ["length", "salt"], "inner")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = ranked.withColumn("p", place("length", (F.col("before") + F.col("nth")).cast("long")))
    return out.select(*cols, "p.sequence_id", "p.offset", *(["ids"] if with_ids else []))


def op1(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
