import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from docstrata.llm import packing, quality
from tests.llm import test_near_dup

LEAK_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def judged_good(docs, labels, spark):
    """Ids that the hierarchical posterior does not reject, from the fitted weights, in plain loops."""
    b, _ = quality.train(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), labels)
    z = {d.doc_id: float(np.clip(b[0] + np.array(quality.measures(d.text or "")) @ b[1:], -12, 12)) for d in docs}
    p = {i: 1 / (1 + np.exp(-x)) for i, x in z.items()}
    mu = float(np.mean(list(p.values())))

    def groups(key):
        out = {}
        for d in docs:
            out.setdefault(key(d), []).append(p[d.doc_id])
        return {g: (len(v), sum(v)) for g, v in out.items()}

    def shrunk(sizes, prior):
        n, g = sum(c for c, _ in sizes.values()), len(sizes)
        between = sum(c * (s / c - prior(k)) ** 2 for k, (c, s) in sizes.items())
        within = sum(prior(k) * (1 - prior(k)) * c for k, (c, _) in sizes.items()) / n
        tau = (between - g * within) / n
        k0 = quality.STRONGEST if n <= g or tau <= 0 else float(np.clip(within / tau - 1, 1, quality.STRONGEST))
        return {k: (s + k0 * prior(k)) / (c + k0) for k, (c, s) in sizes.items()}

    hosts = shrunk(groups(lambda d: d.source), lambda k: mu)
    paths = shrunk(groups(lambda d: (d.source, d.lang)), lambda k: hosts[k[0]])
    odds = lambda r: np.log(r / (1 - r))
    return {d.doc_id for d in docs if z[d.doc_id] - odds(mu) + odds(paths[d.source, d.lang]) < 0}


def one_of_each(docs):
    found = test_near_dup.brute([(d.doc_id, d.text) for d in docs], 5, 80, 100)
    return {i for i, (_, c) in found.items() if i == c}


def without_repeats(docs, window=50):
    first, out = {}, {}
    words = {d.doc_id: (d.text or "").encode().split() for d in docs}
    for i in sorted(words):
        for at in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][at : at + window]), i)
    for d in docs:
        w, gone = words[d.doc_id], set()
        for at in range(len(w) - window + 1):
            if first[tuple(w[at : at + window])] < d.doc_id:
                gone.update(range(at, at + window))
        if not gone:
            out[d.doc_id] = d.text
        elif len(gone) < len(w):
            out[d.doc_id] = b" ".join(x for n, x in enumerate(w) if n not in gone).decode()
    return out


def free_of_leaks(docs, items, window=13):
    split = lambda t: LEAK_WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    windows = set()
    for t in items:
        w = split(t)
        n = min(len(w), window)
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    kept = set()
    for d in docs:
        w = split(d.text)
        if not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            kept.add(d.doc_id)
    return kept


def test_every_stage_equals_brute_force_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    columns, stages = docs.columns, dict(cp.STAGES)
    kept = {}
    rows = docs.collect()
    for name in list(stages)[:-1]:
        docs = stages[name](spark, spark.createDataFrame(rows, docs.schema), sf)
        assert docs.columns == columns, name
        before, rows = rows, docs.collect()
        ids = {r.doc_id for r in rows}
        assert len(ids) == len(rows)
        if name == "quality_classifier":
            want = judged_good(before, labels, spark)
        elif name == "minhash_near_dedup":
            want = one_of_each(before)
        elif name == "substring_dedup":
            texts = without_repeats(before)
            assert {r.doc_id: r.text for r in rows} == texts
            want = set(texts)
        else:
            want = free_of_leaks(before, [r.text for r in items.collect()])
        assert ids == want, name
        kept[name] = len(ids)
    assert list(kept.values()) == sorted(kept.values(), reverse=True) and min(kept.values()) > 0

    pieces = stages["best_fit_packing"](spark, spark.createDataFrame(rows, docs.schema), sf)
    encode = packing.Encoder(packing.tokenizer_path())
    want = {r.doc_id: len(encode(r.text or "")) + 1 for r in rows}
    assert {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    full = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= packing.MAX_TOKENS for r in full)
