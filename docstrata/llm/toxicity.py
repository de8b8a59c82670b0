"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton on folded text.

Folding lower-cases, maps look-alike letters of other scripts and digits used as letters onto one alphabet, and turns
everything else into single breaks, so that entries anchored at word beginnings match through such disguises. Weights
are smoothed log odds of document frequencies in labelled documents; phrases around entries that only clean documents
use become exceptions. The matched weight, normalised by length, is calibrated to a probability.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, free_name, pin

#: About how many labelled documents, at most, the lexicon and the calibration are learned from.
SAMPLE = 20_000
#: Fewest toxic documents of an entry, and least log odds.
SUPPORT, WEIGHT = 6, 2.0
#: Letters of an entry that stands for all words beginning with it.
STEMS = range(4, 9)
#: Look-alike letters of other scripts; fixed values.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ǀ": "l"}
#: Digits and signs used as letters; l, 1 and i fold onto one letter, since 1 stands for either. Fixed values.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i"}
_INVISIBLE = dict.fromkeys([0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), 0x2060, 0xFEFF])


class _Table(dict):
    """Character map of fold(): letters as they are, everything else a break."""

    def __missing__(self, code: int):
        c = chr(code)
        out = HOMOGLYPHS.get(c) or (c if c.isalpha() else " ")
        out = DIGITS.get(out, out)
        self[code] = out
        return out


_TABLE = _Table({ord(k): v for k, v in DIGITS.items()} | _INVISIBLE)


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return " ".join(text.lower().translate(_TABLE).split())


def _terms(folded: str) -> set[str]:
    """Entries a text could have: whole words ("word ") and word beginnings ("word")."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(w + " ")
            out.update(w[:k] for k in STEMS if len(w) >= k)
    return out


def _partial(kind):
    """Counts by label of what kind(text) yields, one row for each key and batch of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (Counter(), Counter())
            for t, y in zip(batch.column(0), batch.column(1), strict=True):
                both[y.as_py()].update(kind(fold(t.as_py() or "")))
            keys = list(both[0].keys() | both[1].keys())
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array([both[0][k] for k in keys], pa.int64()), pa.array([both[1][k] for k in keys], pa.int64())], ["key", "clean", "toxic"])

    return run


def _count(sample: DataFrame, kind, where: str) -> list[tuple[str, int, int]]:
    rows = sample.mapInArrow(_partial(kind), "key string, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(where)
    return sorted(tuple(r) for r in rows.collect())  # terms of the sample that where lets through


class Matcher:
    """Matched weight of a folded text; entries inside an exception phrase do not count."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for term, w in weights.items():
            self.machine.add_word(" " + term, (len(term) + 1, w))
        for phrase in exceptions:
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.machine.make_automaton()
        self.usable = bool(weights)

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(begin, end, weight) of entries, the longest at each begin."""
        found: dict[int, tuple[int, float]] = {}
        shields = []
        for end, (n, w) in self.machine.iter(f" {folded} ") if self.usable else ():
            if w is None:
                shields.append((end + 1 - n, end))
            elif (at := end + 1 - n) not in found or found[at][0] < end:
                found[at] = (end, w)
        return [(a, e, w) for a, (e, w) in found.items() if not any(x <= a and e <= y for x, y in shields)]

    def features(self, folded: str) -> tuple[float, float]:
        """(1 if any entry matches, log of 1 + matched weight a hundred words)."""
        weight = sum(w for *_, w in self.hits(folded))
        words = folded.count(" ") + 1
        return float(weight > 0), math.log1p(100 * weight / words)


def _around(weights: dict[str, float]):
    """Two-word phrases around matched entries."""
    matcher = None

    def kind(folded: str) -> set[str]:
        nonlocal matcher
        matcher = matcher or Matcher(weights, [])
        text, out = f" {folded} ", set()
        for a, _, _ in matcher.hits(folded):
            end = text.index(" ", a + 1)
            word = text[a + 1 : end]
            before, after = text[:a].rsplit(" ", 1)[-1], text[end + 1 :].split(" ", 1)[0]
            out.update(x for x in (f"{before} {word}" if before else "", f"{word} {after}" if after else "") if x)
        return out

    return kind


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge-penalised logistic model, the first for a constant, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    b, pen = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pen, x.T @ (y - p) - pen @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, size: int) -> DataFrame:
    """(text, y) of about size labelled documents, those of the smallest hashes; all if there are no more."""
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    y = y.withColumn("h", F.abs(F.xxhash64("doc_id") % 1_000_000))
    n = y.count()
    if n > size:
        y = y.where(F.col("h") < int(1_000_000 * size / n))
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(y.select("doc_id", "y")), "doc_id").select("text", "y")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> dict:
    """Lexicon, exceptions and calibration from labels (doc_id, toxic); without usable labels, an empty lexicon.

    It learns from about `sample` labelled documents at most; the lexicon has every entry over SUPPORT and WEIGHT
    there, and exceptions are those given and every phrase around entries that three clean documents and no toxic one
    have. Null texts teach nothing.
    """
    data = pin(bounded_sample(docs, labels, "toxic", sample).repartition(max(4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    totals = {r[0]: r[1] for r in data.groupBy("y").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    weights: dict[str, float] = {}
    if n0 and n1:
        shift = math.log((n0 + 1) / (n1 + 1))
        for term, c, t in _count(data, _terms, f"toxic >= {SUPPORT} and ln((toxic + 0.5) / (clean + 0.5)) + {shift} >= {WEIGHT}"):
            weights[term] = math.log((t + 0.5) / (c + 0.5)) + shift
        # A word beginning says as much as the longer entries that it covers.
        keep = {t for t in weights if not any(weights.get(t[:k], -9) >= weights[t] - 1 for k in STEMS if k < len(t.rstrip()) or (k == len(t.rstrip()) and t.endswith(" ")))}
        weights = {t: w for t, w in weights.items() if t in keep}
    shields = [fold(x) for x in exceptions]
    if weights:
        shields += [k for k, c, t in _count(data, _around(weights), "toxic = 0 and clean >= 3")]
    model = {"weights": weights, "exceptions": shields, "b": np.array([-2.0, 4.0, 0.5])}
    if weights:
        rows = data.select(_features(model)("text").alias("f"), "y").select("f.*", "y").collect()  # bounded by sample
        a = np.array(rows, float)
        model["b"] = logistic(a[:, :2], a[:, 2])
    return model


def _features(model: dict):
    @F.pandas_udf("hit double, density double")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Matcher(model["weights"], model["exceptions"])
        for text in batches:
            yield pd.DataFrame([m.features(fold(t or "")) for t in text], columns=["hit", "density"], dtype=float)

    return f


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with a last column more, `toxicity` (`toxicity_2` and so on if docs has that name), from 0 to 1. Null and
    empty texts get the score of a text without matches."""
    b = model["b"]

    @F.pandas_udf("double")
    def s(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(model["weights"], model["exceptions"])
        for text in batches:
            f = np.array([m.features(fold(t or "")) for t in text], float).reshape(-1, 2)
            yield pd.Series(1 / (1 + np.exp(-np.clip(b[0] + f @ b[1:], -30, 30))))

    return docs.select(*docs.columns, s(F.col(text_col)).alias(free_name(docs.columns, "toxicity")))


def held_out():
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    Rows with a null id are scored and not held out; repeated rows each get a row. Null, empty and very long texts are
    scored whole. Other columns are ignored. Without usable labels no text matches anything; an empty table gives no
    rows.
    """
    docs = docs.select("doc_id", "text")
    arrow_batches(docs.sparkSession)
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))


def op2(spark, sf_dir: str) -> DataFrame:
    return toxicity(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
