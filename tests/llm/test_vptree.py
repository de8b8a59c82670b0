import numpy as np

from docstrata.llm import vptree
from docstrata.llm.vptree import build, nearest, op4, search


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            out[i] = sorted(((-float(np.dot(v, x)), j) for j, x in ok if j != i))[:k]
    return out


def compare(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert by.keys() == {q for q, w in want.items() if w}
    for q, rows in by.items():
        rows.sort()
        assert [x[0] for x in rows] == list(range(1, len(want[q]) + 1))
        assert np.allclose([x[2] for x in rows], [-s for s, _ in want[q]], atol=1e-12)
        for (_, i, s), (t, j) in zip(rows, want[q], strict=True):
            assert i == j or abs(s + t) < 1e-12


def test_real_vectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    compare(nearest(df, df.where("vec_id % 20 = 0"), factor=1.0).collect(), brute(rows, 20))


def test_several_shards_and_blocks_are_exact_at_factor_one(spark, monkeypatch):
    for name, value in (("SHARD", 40), ("BLOCK", 7), ("LEAF", 8), ("FAR", 3)):
        monkeypatch.setattr(vptree, name, value)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 5)) * 3
    rows = [(i, [float(x) for x in centres[i % 6] * (1 + i % 3) + rng.normal(size=5) / 4]) for i in range(400)]
    rows += [(i, [1.0] * 5) for i in range(400, 520)]  # more equal vectors than a shard holds
    rows += [(i, [float(i), 2.0]) for i in range(520, 580)] + [(600, [1.0])]  # other lengths meet their own
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id % 20 = 0"), 10, 1.0).collect()
    for n in (5, 2, 1):
        mine = [r for r in rows if len(r[1]) == n]
        ids = {i for i, _ in mine}
        compare([r for r in got if r.query_id in ids], brute(mine, 10))


def test_recall_of_the_query_over_given_vectors(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in op4(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = total = 0
    for i, v in zip(ids, x, strict=True):
        if i % 20 == 0:
            best = set(ids[np.argsort(-np.where(ids == i, -np.inf, x @ v))[:20]].tolist())
            found, total = found + len(best & got[i]), total + 20
    assert found / total >= 0.97


def figures(x, factor, k=20, leaf=None):
    """(share of vectors compared, recall) of queries with every twentieth vector."""
    leaves, order = build(x, np.random.default_rng(1), leaf)
    x, read = x[order], []
    q = x[::20]
    exact = np.argsort(-(q @ x.T), axis=1)[:, : k + 1]
    found = search(leaves, x, q, k + 1, factor, read=read)
    return sum(read) / (len(q) * len(x)), np.mean([len(set(e) & set(f)) / len(e) for e, f in zip(exact.tolist(), map(np.ndarray.tolist, found), strict=True)])


def test_what_pruning_spares(spark):
    """README's figures: little on the vectors given, which have no structure; most where vectors lie in groups."""
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()], float)
    for factor in (1.0, 2.0, 4.0, 6.0, 8.0, 10.0):
        read, recall = figures(x, factor)
        assert read > 0.5 or recall < 0.9, factor
    rng = np.random.default_rng(2)
    grouped = np.repeat(rng.normal(size=(50, 64)), 60, axis=0) + rng.normal(size=(3000, 64)) / 20
    grouped /= np.linalg.norm(grouped, axis=1)[:, None]
    read, recall = figures(grouped, 1.0)
    assert read < 0.5 and recall == 1.0


def test_odd_vectors_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(1)]) for i in range(60)]
    rows += [(i, [1.0, 0.0, 2.0, 0.0]) for i in range(60, 140)]
    rows += [(200, None), (220, [0.0] * 4), (240, [1.0, None, 2.0, 3.0]), (260, [float("nan")] * 4), (280, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (60, [1.0, 0.0, 2.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, shard string")
    got = nearest(df, df.where("vec_id % 20 = 0"), 20).collect()
    want = brute(rows[:-1], 20)
    compare(got, want)
    tied = [r.vec_id for r in sorted((r for r in got if r.query_id == 100), key=lambda r: r["rank"]) if abs(r.score - 5) < 1e-12]
    assert tied == [i for i in range(60, 140) if i != 100][: len(tied)] and len(tied) >= 1


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(df, df).count() == 0


def test_relaxed_factor_reads_less_with_recall():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3))
    leaves, order = build(x, rng, 50)
    x = x[order]
    q = rng.normal(size=(40, 3))
    exact = [set(np.argsort(((x - v) ** 2).sum(axis=1))[:10]) for v in q]
    assert all(e <= set(f) for e, f in zip(exact, search(leaves, x, q, 10, 1.0), strict=True))
    found = [len(e & set(f)) / 10 for e, f in zip(exact, search(leaves, x, q, 10, 1.3), strict=True)]
    assert np.mean(found) >= 0.9
