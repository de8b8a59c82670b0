"""Document quality by hierarchical empirical Bayes.

A logistic model on simple text measures gives each document's evidence. Evidence is averaged over hosts and over
paths of hosts by grouped sums; a host is shrunk toward the whole corpus and a path toward its host, the more the
fewer documents they have, with strengths fitted from how far hosts and paths really differ. A document's posterior
joins its own evidence with its path's posterior as prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, free_name, give_back, lookup_join, pin, unpin
from .toxicity import bounded_sample, logistic

#: Most labelled documents the text model is fitted on.
SAMPLE = 20_000
#: Prior strength, in documents, where hosts or paths do not differ measurably.
STRONGEST = 1_000.0
MEASURES = ("repeats", "distinct", "marks", "shouts", "upper", "pipes", "letters", "length", "longest")
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])


def measures(text: str) -> list[float]:
    """Measures of a text between 0 and about 1; an empty text has none of anything."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, m = max(len(words), 1), max(len(raw), 1)
    marks = sum(raw.count(x) for x in (b"###", b"***", b"%%%", b"$$$", b"&&&"))
    return [
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        marks / n,
        raw.count(b"!!") / n,
        (m - len(raw.translate(None, _UPPER))) / m,
        raw.count(b" | ") / n,
        (m - len(raw.translate(None, _LETTERS))) / m,
        min(np.log1p(len(words)) / 10, 1.0),
        min(max(map(len, words), default=0) / 100, 1.0),
    ]


def _evidence(b: np.ndarray):
    @F.pandas_udf("double")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            x = np.array([measures(t or "") for t in text], float).reshape(-1, len(MEASURES))
            yield pd.Series(np.clip(b[0] + x @ b[1:], -12, 12))
        give_back()

    return f


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _measured(text: pd.Series) -> pd.Series:
    return pd.Series([measures(t or "") for t in text])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """(weights, base rate of low quality); without labels of both kinds, no weights and an even rate."""
    data = bounded_sample(docs, labels, "quality", sample)
    rows = data.select(_measured("text"), "y").collect()  # bounded by sample
    y = 1.0 - np.array([r[1] for r in rows], float)
    if len(set(y)) < 2:
        return np.zeros(1 + len(MEASURES)), 0.5
    return logistic(np.array([r[0] for r in rows], float), y, ridge=1e-3), float(np.clip(y.mean(), 1e-4, 1 - 1e-4))


def _strength(groups: DataFrame, prior: str) -> float:
    """Prior strength k of a beta-binomial with mean `prior`, by the method of moments over groups (n, s)."""
    rate = F.col("s") / F.col("n")
    row = groups.agg(F.sum(F.col("n") * (rate - F.col(prior)) ** 2), F.sum(F.col(prior) * (1 - F.col(prior)) * F.col("n")), F.sum(F.col("n")), F.count(F.lit(1))).first()
    between, within, n, g = (float(v or 0) for v in row)
    if n <= g or within <= 0:
        return STRONGEST
    mean_var = within / n
    tau = (between - g * mean_var) / n  # variance between groups beyond what counts alone give
    return STRONGEST if tau <= 0 else float(np.clip(mean_var / tau - 1, 1.0, STRONGEST))


def quality(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """docs with a last column more, a struct `quality` (`quality_2` and so on if docs has that name): own (P(low) from
    the text alone), host, path (shrunk rates), p_low, rejected.

    path_col is any finer part of a host; the tables given have no paths, so the query takes a host's languages. Null
    hosts and paths are groups of their own; null and empty texts are judged by their measures, all zero. Rows, with
    null ids too, are judged one by one, so repeated rows get equal answers. Without labels all evidence is even and
    nothing is rejected unless its site is. An empty table gives no rows; other columns pass through.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    b, base = train(docs, labels, sample)
    z = docs.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), _evidence(b)(F.col("text")).alias("z"))
    p = 1 / (1 + F.exp(-F.col("z")))
    paths = pin(z.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s")))
    mu = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    mu = float(np.clip(base if mu is None else mu, 1e-4, 1 - 1e-4))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("mu", F.lit(mu))
    k = _strength(hosts, "mu")
    hosts = pin(hosts.select("host", ((F.col("s") + k * mu) / (F.col("n") + k)).alias("host_rate")))
    both = pin(paths.join(hosts, paths["host"].eqNullSafe(hosts["host"]), "left").select(paths["host"], "path", "n", "s", "host_rate"))
    k = _strength(both, "host_rate")
    key, rate, score, out = (free_name(docs.columns, x) for x in ("site", "rate", "evidence", "quality"))
    site = pin(both.select(F.xxhash64(F.struct("host", "path")).alias(key), F.struct("host_rate", ((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate")).alias(rate)))
    unpin(paths, hosts, both)
    rows = lookup_join(docs.withColumn(key, F.xxhash64(F.struct(F.col(host_col).alias("host"), F.col(path_col).alias("path")))), site, key, "left")
    rows = rows.withColumn(score, _evidence(b)(F.col("text")))
    odds = lambda r: F.log(r / (1 - r))
    post = F.col(score) - odds(F.lit(mu)) + odds(F.least(F.greatest(F.col(rate)["path_rate"], F.lit(1e-6)), F.lit(1 - 1e-6)))
    p_low = 1 / (1 + F.exp(-post))
    own = 1 / (1 + F.exp(-F.col(score)))
    return rows.select(*docs.columns, F.struct(own.alias("own"), F.col(rate)["host_rate"].alias("host"), F.col(rate)["path_rate"].alias("path"), p_low.alias("p_low"), (p_low >= threshold).alias("rejected")).alias(out))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that quality() does not reject, with the columns they had, whatever their names; see there for
    nulls, repeated rows and empty tables."""
    rows = quality(docs, labels)
    return rows.where(~F.col(rows.columns[-1])["rejected"]).select(*docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality(docs, labels)
    return out.select("doc_id", F.round("quality.own", 6).alias("p_text"), F.round("quality.path", 6).alias("site_rate"), F.round("quality.p_low", 6).alias("p_low"), F.col("quality.rejected").alias("rejected"))
