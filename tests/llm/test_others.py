import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docstrata.llm import decontaminate, licenses, packing, quality, sharding, token_counts, toxicity

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "no id here"), (5, "word " * 30000)]


def odd(spark, extra="x string"):
    return spark.createDataFrame([(i, t, "s", "p", "c") for i, t in ODD], f"doc_id long, text string, source string, lang string, {extra}")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, x string")


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_holds_every_piece(lengths):
    hist = np.zeros(65, np.int64)
    for l, n in lengths.items():
        hist[l] = n
    used, sequences = np.zeros(65, np.int64), 0
    for items, count in packing.plan(hist, 64, 16):
        assert count > 0 and sum(l * k for l, k in items) <= 64
        for l, k in items:
            used[l] += k * count
        sequences += count
    assert (used == hist).all() and sequences >= -(-int((hist * np.arange(65)).sum()) // 64)


def test_pack_round_trip(spark):
    rows = packing.pack(odd(spark, "ids string"), max_tokens=64, with_ids=True).collect()
    tokenizer = packing._load(packing.tokenizer_path())
    want = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)
    assert sum(r.length for r in rows) == want and all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    place = {}
    for r in rows:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in place.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(empty(spark)).count() == 0


def test_encoder_equals_tokenizer():
    encode, tokenizer = packing.Encoder(packing.tokenizer_path()), packing._load(packing.tokenizer_path())
    for t in ("It's we'RE ''s don''t x\u0085y Ünï²³ 1234 «»…", "a\x1cb <|endoftext|>", "ΑΣ σς İI ＡＢ é", "", "\xad\xa0b"):
        assert list(encode(t)) == tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_with_few_remembered_words(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 6)
    encode, tokenizer = packing.Encoder(packing.tokenizer_path()), packing._load(packing.tokenizer_path())
    for t in ("one two", "two three four", "one five", "six one two", "one two three four five six seven eight", "", "eight one", "nine two one"):
        assert list(encode(t)) == tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=4), max_size=8), st.sets(st.text("abc", min_size=1, max_size=4), max_size=8), st.text("abcd", min_size=1, max_size=12))
def test_piece_counts(first, rest, word):
    first, rest, word = {x.encode() for x in first}, {x.encode() for x in rest}, word.encode()
    at = n = 0
    while at < len(word) and n >= 0:
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (rest if at else first)), None)
        at, n = (end, n + 1) if end else (len(word), -1)
    assert token_counts.PieceCounter(first, rest)(word) == n


def test_token_counts_odd_rows(spark):
    got = token_counts.token_counts(odd(spark)).collect()
    assert len(got) == len(ODD) and {r.n_words for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_toxicity_learns_disguised_words(spark):
    docs = [(i, f"plain words number {i} here " + ("you moron " if i % 2 else "you friend ") + f"tail{i}") for i in range(400)]
    docs += [(1000, "such a m0r0n you are"), (1001, "such a mоrоn"), (1002, "a friend"), (1003, None), (1004, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()}
    assert all(got[i].predicted == i % 2 for i in range(400))
    assert [got[i].predicted for i in range(1000, 1005)] == [1, 1, 0, 0, 0]
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    none = labels.limit(0)
    assert toxicity.toxicity(odd(spark), none).where("predicted = 1").count() == 0
    assert toxicity.toxicity(empty(spark), none).count() == 0


def test_toxicity_held_out_accuracy(spark):
    """Labels the query never learns from: nearly all that it flags are toxic, and it finds most of them."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic in (0, 1)")
    rows = toxicity.op2(spark, sf).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    flagged, toxic = [r for r in rows if r.predicted], [r for r in rows if r.toxic]
    right = sum(r.toxic for r in flagged)
    assert len(toxic) > 50 and right / len(flagged) >= 0.95 and right / len(toxic) >= 0.85
    scores = np.sort([r.score for r in rows if not r.toxic])
    below = [np.searchsorted(scores, r.score, "left") + np.searchsorted(scores, r.score, "right") for r in toxic]
    assert np.mean(below) / (2 * len(scores)) >= 0.93


def test_exceptions_shield_entries():
    m = toxicity.Matcher({"moron": 2.0}, ["oxy moron"])
    assert m.features("an oxy moron")[0] == 0 and m.features("a moron")[0] == 1


def test_quality_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    judged = quality.quality(docs, half).select("doc_id", "quality.rejected")
    got = judged.join(labels.where("doc_id % 2 = 1"), "doc_id").selectExpr("rejected = (quality = 0) as ok")
    oks = [r.ok for r in got.collect()]
    assert len(oks) > 20 and sum(oks) / len(oks) >= 0.9
    assert quality.quality(odd(spark), labels.limit(0)).count() == len(ODD)
    assert quality.keep_good(empty(spark), labels).count() == 0


def test_decontamination_odd_rows(spark):
    items = spark.createDataFrame([("a", "short one"), ("b", None), ("c", " ".join(f"w{i}" for i in range(15))), (None, "one"), ("d", "...")], "item_id string, text string")
    docs = odd(spark).union(spark.createDataFrame([(9, "x " + " ".join(f"W{i}" for i in range(1, 14)) + " y SHORT One", "s", "p", "c"), (10, "short", "s", "p", "c")], "doc_id long, text string, source string, lang string, x string"))
    got = {}
    for r in decontaminate.contamination(docs, items).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, list(r["items"])))
    assert got[9] == [(17, 15, ["a", "c"])] and got[10] == [(1, 0, [])]
    assert got[4] == [(1, 1, [])] * 2 and got[1] == got[2] == got[3] == [(0, 0, [])]
    assert decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty(spark), items).count() == 0


def test_decontamination_by_shuffle_equals_broadcast(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.hits)) for r in decontaminate.contamination(docs, items).collect())
    want = rows()
    assert any(r[2] for r in want)
    for bound in ("PREFIX_ROWS", "PREFIX_BYTES"):
        with monkeypatch.context() as m:
            m.setattr(decontaminate, bound, 0)
            assert rows() == want, bound


def test_shards_fit(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50), "clash") for i in range(2000)], "doc_id long, text string, bytes string")
    rows = sharding.shard(docs, 1000).selectExpr("doc_id", "length(text) as n", "shard.*").collect()
    size, prefix = {}, {}
    for r in rows:
        size[(r.depth, r.bucket)] = size.get((r.depth, r.bucket), 0) + r.n
        prefix[(r.depth, r.bucket)] = r.bytes
    assert size == prefix and max(size.values()) <= 1000 and len(rows) == 2000
    assert sharding.shard(odd(spark), 1000).count() == len(ODD) and sharding.shard(empty(spark), 10).count() == 0


def test_licenses(spark):
    text = "intro\nReleased under the MIT  license!\nLicensed under CC BY-NC 4.0.\nThe end"
    docs = odd(spark).union(spark.createDataFrame([(9, text, "s", "p", "c"), (9, text, "s", "p", "c")], "doc_id long, text string, source string, lang string, x string"))
    got = {(r.doc_id, r.line): r.license for r in licenses.scan(docs).collect()}
    assert got == {(9, 1): "MIT", (9, 2): "CC-BY-NC-4.0"}
    mit = "Released under the MIT License."
    padded = [(1, mit + " -" * 20000, "a"), (2, "Released under\n" + "\n. " * 20000 + "the MIT License.", "b"), (3, "b c " * 9000, "c"), (4, "released under the MIT", "d"), (4, "under the MIT license", "d")]
    got = {(r.doc_id, r.line, r.dice) for r in licenses.scan(spark.createDataFrame(padded, "doc_id long, text string, line string")).collect()}
    assert got == {(1, 0, 1.0), (2, -1, 1.0), (2, 0, 1.0), (4, 0, round(6 / 7, 6))}
    assert licenses.scan(empty(spark)).count() == 0
