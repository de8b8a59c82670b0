"""Greedy word-piece counts by a linear longest-match automaton.

A trie of the vocabulary gets failure links: where no edge fits, the longest-match pieces of what was read are known,
so the automaton adds their precomputed number and goes on at the failure node. Every byte is read once and no piece
is ever built. Words are counted once and remembered.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, arrow_batches, byte_alphabet
from .packing import tokenizer_path


def load_vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """(word beginnings, continuations) of a byte-level vocabulary: tokens with and without a leading space.

    Single bytes that lack a token with a space may also begin a word, so that every word has pieces.
    """
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    table = byte_alphabet()
    raw = [bytes(table[c] for c in t) for t in tokens if all(c in table for c in t)]
    first = {t[1:] for t in raw if t[:1] == b" " and len(t) > 1 and b" " not in t[1:]}
    rest = {t for t in raw if b" " not in t and t}
    return first | {bytes([b]) for b in range(256)}, rest | {bytes([b]) for b in range(256)}


class PieceCounter:
    """Number of greedy longest-match pieces of a word; -1 if some part has no piece."""

    def __init__(self, first: set[bytes], rest: set[bytes]) -> None:
        edges: list[dict[int, int]] = [{}, {}]  # 0: start of a word, 1: inside it
        piece = [False, False]
        for root, vocabulary in ((0, first), (1, rest)):
            for token in vocabulary:
                at = root
                for b in token:
                    at = edges[at].setdefault(b, len(edges))
                    if at == len(edges):
                        edges.append({})
                        piece.append(False)
                piece[at] = True
        fail, pops = [-1] * len(edges), [0] * len(edges)
        queue = deque((0, 1))
        while queue:
            u = queue.popleft()
            for b, v in edges[u].items():
                if piece[v]:
                    fail[v], pops[v] = 1, 1
                else:
                    z, n = fail[u], pops[u]
                    while z >= 0 and b not in edges[z]:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = edges[z][b], n
                queue.append(v)
        self.edges, self.fail, self.pops = edges, fail, pops

    def __call__(self, word: bytes) -> int:
        edges, fail, pops = self.edges, self.fail, self.pops
        u = n = 0
        for b in word:
            while b not in edges[u]:
                if fail[u] < 0:
                    return -1
                n += pops[u]
                u = fail[u]
            u = edges[u][b]
        while u != 1:
            if fail[u] < 0:
                return -1 if word else 0
            n += pops[u]
            u = fail[u]
        return n


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = PieceCounter(*load_vocabulary(path))

        class Cache(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= CACHE_ENTRIES:
                    self.clear()
                n = self[word] = count(word)
                return n

        cache = Cache()
        for batch in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for t in batch.column(1):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                pieces = list(map(cache.__getitem__, words))
                unknown = pieces.count(-1)
                n_words.append(len(words)), n_tokens.append(sum(pieces) + 2 * unknown), n_unknown.append(unknown)
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_unknown, pa.int64())], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_tokens, n_unknown. No shuffle.

    Words are runs without ASCII white space, as UTF-8 bytes; a word without pieces counts as one unknown token. Null
    and empty texts have none; null ids and repeated rows are kept; other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_counts(path or tokenizer_path("byte_bpe_50k.json")), "doc_id long, n_words long, n_tokens long, n_unknown long")


def op9(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
