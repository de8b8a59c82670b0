"""Every column of op1, op2, op7 and op9 against plain loops over whole small tables."""

import math
import zlib
from collections import Counter

import numpy as np

from docstrata.llm import packing, quality, token_counts, toxicity


def read(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet").collect()


def test_op1(spark, sf):
    tokenizer = packing._load(packing.tokenizer_path())
    want, lengths = {}, []
    for d in read(spark, sf, "documents"):
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[d.doc_id, n] = (at, len(part), zlib.crc32(part.tobytes()))
            lengths.append(len(part))
    got = packing.op1(spark, sf).collect()
    assert len(got) == len(want) and {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    room = []  # best fit, longest first, one by one
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in room if r >= n), default=None)
        if fit is not None:
            room.remove(fit)
        room.append((2048 if fit is None else fit) - n)
    assert -(-sum(lengths) // 2048) <= len(sequences) <= len(room) * 1.02 + 1


def naive_hits(weights, exceptions, folded):
    text, found = f" {folded} ", {}
    for term, w in weights.items():
        at = text.find(" " + term)
        while at >= 0:
            if at not in found or found[at][0] < at + len(term):
                found[at] = (at + len(term), w)
            at = text.find(" " + term, at + 1)
    shields = []
    for phrase in exceptions:
        at = text.find(f" {phrase} ")
        while at >= 0:
            shields.append((at, at + len(phrase) + 1))
            at = text.find(f" {phrase} ", at + 1)
    return [(a, e, w) for a, (e, w) in sorted(found.items()) if not any(x <= a and e <= y for x, y in shields)]


def features(weights, exceptions, folded):
    weight = sum(w for *_, w in naive_hits(weights, exceptions, folded))
    return [float(weight > 0), math.log1p(100 * weight / (folded.count(" ") + 1))]


def test_op2(spark):
    sf = "/root/testdata/sf0.01"
    docs = {d.doc_id: toxicity.fold(d.text or "") for d in read(spark, sf, "documents")}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    labelled = [(docs[r.doc_id], r.toxic) for r in read(spark, sf, "labels") if r.toxic in (0, 1) and not held(r.doc_id)]
    n = Counter(y for _, y in labelled)
    counts = {0: Counter(), 1: Counter()}
    for t, y in labelled:
        terms = set()
        for w in set(t.split()):
            if len(w) >= 3:
                terms |= {w + " ", *(w[:k] for k in toxicity.STEMS if len(w) >= k)}
        counts[y].update(terms)
    shift = math.log((n[0] + 1) / (n[1] + 1))
    odds = {t: math.log((c + 0.5) / (counts[0][t] + 0.5)) + shift for t, c in counts[1].items() if c >= toxicity.SUPPORT}
    odds = {t: w for t, w in odds.items() if w >= toxicity.WEIGHT}
    shorter = lambda t: [t[:k] for k in toxicity.STEMS if k < len(t.rstrip()) or (k == len(t.rstrip()) and t.endswith(" "))]
    weights = {t: w for t, w in odds.items() if not any(s in odds and odds[s] >= w - 1 for s in shorter(t))}
    around = {0: Counter(), 1: Counter()}
    for t, y in labelled:
        words = t.split(" ")
        begins = np.cumsum([0, *(len(w) + 1 for w in words)])
        phrases = set()
        for a, *_ in naive_hits(weights, [], t):
            i = int(np.searchsorted(begins, a))
            phrases |= {f"{words[i - 1]} {words[i]}"} if i else set()
            phrases |= {f"{words[i]} {words[i + 1]}"} if i + 1 < len(words) else set()
        around[y].update(phrases)
    exceptions = [p for p, c in around[0].items() if c >= 3 and not around[1][p]]
    x = np.array([features(weights, exceptions, t) for t, _ in labelled])
    b = toxicity.logistic(x, np.array([y for _, y in labelled], float))
    got = toxicity.op2(spark, sf).collect()
    assert weights and len(got) == len(docs)
    for r in got:
        score = 1 / (1 + math.exp(-(b[0] + np.dot(features(weights, exceptions, docs[r.doc_id]), b[1:]))))
        assert abs(r.score - score) < 1e-9 and r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.7)


def posteriors(docs, b):
    """doc_id -> (own, path rate, P(low)) by plain sums."""
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
    return {d.doc_id: (p[d.doc_id], paths[d.source, d.lang], 1 / (1 + np.exp(-(z[d.doc_id] - odds(mu) + odds(paths[d.source, d.lang]))))) for d in docs}


def test_op7(spark, sf):
    docs = read(spark, sf, "documents")
    b, _ = quality.train(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")))
    want = posteriors(docs, b)
    got = quality.op7(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert np.allclose([r.p_text, r.site_rate, r.p_low], want[r.doc_id], atol=2e-6)
        assert r.rejected == (want[r.doc_id][2] >= 0.5)


def test_op9(spark, sf):
    first, rest = token_counts.load_vocabulary(packing.tokenizer_path("byte_bpe_50k.json"))
    longest = max(map(len, first | rest))

    def pieces(word):
        at = n = 0
        while at < len(word):
            at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in (rest if at else first))
            n += 1
        return n

    known = {}
    want = {}
    for d in read(spark, sf, "documents"):
        words = (d.text or "").encode().split()
        want[d.doc_id] = (len(words), sum(known.setdefault(w, 0) or known.__setitem__(w, pieces(w)) or known[w] for w in words), 0)
    assert {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.op9(spark, sf).collect()} == want
