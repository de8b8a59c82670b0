"""Nearest neighbours by inner product with vantage-point trees, one for each shard of the vectors.

Vectors get one coordinate more that makes all of them equally long, so that the largest inner product is the least
Euclidean distance, for which the triangle inequality holds. A shard holds the vectors nearest to one of some vantage
points, and knows between which distances from all of them its vectors lie. A tree splits its vectors by rank of the
distance to a vantage point of large spread and keeps the range of distances on either side. A leaf, or a whole shard,
whose lower bound times the relaxing factor exceeds a query's current k-th distance is not read. Factor one prunes
nothing that could count, so it is exact.

Queries first ask the shard of their own place; what they find there bounds which other shards they are sent to. Each
pair of a shard and a block of queries is a task of bounded size.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, pin

#: Vectors of a shard at most (on average where a vantage point's place must be split), of a leaf at most, and queries
#: of a block on average.
SHARD, LEAF, BLOCK = 65_536, 64, 16_384
#: Most vantage points of shards, and vectors of the sample they are chosen from; every vector is indexed.
POINTS, SAMPLE = 1024, 8192
#: Leaves that a query reads in the order of their bounds before it goes through the others.
FIRST = 4
#: Vantage points tried for each split of a tree, and vectors that their spread is measured on.
TRIED, MEASURED = 8, 128
#: Factor of the query. README has the leaves read and the recall of others.
FACTOR = 5.0
#: Distances are compared with this slack, since they are rounded.
SLACK = 1e-7


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d2 = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * x @ y.T
    return np.sqrt(np.maximum(d2, 0))


def build(vectors: np.ndarray, rng: np.random.Generator, leaf: int | None = None) -> tuple[list, np.ndarray]:
    """(leaves, order): each leaf is (begin, end, [(vantage point, least, greatest distance), ...]) over vectors[order].

    The vantage point of a split is that of a few whose distances spread most. The split is by rank, so equal
    distances never make a leaf larger than leaf vectors.
    """
    leaf = LEAF if leaf is None else leaf
    leaves, out, at = [], [], 0
    stack = [(np.arange(len(vectors)), [])]
    while stack:
        rows, path = stack.pop()
        if len(rows) <= leaf:
            out.append(rows)
            leaves.append((at, at + len(rows), path))
            at += len(rows)
            continue
        tried, measured = (rows[rng.integers(len(rows), size=min(n, len(rows)))] for n in (TRIED, MEASURED))
        point = vectors[tried[int(_distances(vectors[tried], vectors[measured]).std(axis=1).argmax())]]
        d = np.sqrt(((vectors[rows] - point) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        for part in (order[:half], order[half:]):
            stack.append((rows[part], [*path, (point, d[part].min(), d[part].max())]))
    return leaves, np.concatenate(out) if out else np.empty(0, np.int64)


def search(leaves: list, vectors: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0, kth: np.ndarray | None = None, read: list | None = None) -> list[np.ndarray]:
    """For each query the rows (of the reordered vectors) that may be among its k nearest, by relaxed pruning.

    kth: distances that are known to hold k others already; read: gets the vectors compared.
    """
    bound = np.zeros((len(queries), len(leaves)))
    seen: dict[int, np.ndarray] = {}
    for n, (_, _, path) in enumerate(leaves):
        for point, low, high in path:
            d = seen.get(id(point))
            if d is None:
                d = seen[id(point)] = np.sqrt(((queries - point) ** 2).sum(axis=1))
            bound[:, n] = np.maximum(bound[:, n], np.maximum(low - d, d - high))
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full((len(queries), k), np.inf) if kth is None else np.repeat(np.asarray(kth, float)[:, None], k, axis=1)
    rows = np.full((len(queries), k), -1, np.int64)
    extra: list[list[np.ndarray]] = [[] for _ in queries]

    def compare(leaf: int, who: np.ndarray) -> None:
        begin, end, _ = leaves[leaf]
        if read is not None:
            read.append(len(who) * (end - begin))
        d = _distances(queries[who], vectors[begin:end])
        better = np.flatnonzero(d.min(axis=1) <= best[who, -1] + SLACK)
        who, d = who[better], d[better]
        all_d = np.concatenate([best[who], d], axis=1)
        all_r = np.concatenate([rows[who], np.broadcast_to(np.arange(begin, end), d.shape)], axis=1)
        top = np.argsort(all_d, axis=1, kind="stable")[:, :k]
        best[who], rows[who] = np.take_along_axis(all_d, top, 1), np.take_along_axis(all_r, top, 1)
        near = d <= best[who][:, -1:] + SLACK  # ties at the k-th place stay candidates
        for i in np.flatnonzero(near.any(axis=1)):
            extra[who[i]].append(np.flatnonzero(near[i]) + begin)

    # Each query's nearest leaves give its first k-th distance; the others are read leaf by leaf, for all queries left.
    left = np.ones(bound.shape, bool)
    every = np.arange(len(queries))
    for rank in range(min(FIRST, len(leaves))):
        at = order[:, rank]
        left[every, at] = False
        for n in np.unique(at):
            who = np.flatnonzero((at == n) & (bound[:, n] * factor <= best[:, -1] + SLACK))
            if len(who):
                compare(n, who)
    for n in range(len(leaves)):
        who = np.flatnonzero(left[:, n] & (bound[:, n] * factor <= best[:, -1] + SLACK))
        if len(who):
            compare(n, who)
    return [np.unique(np.concatenate([rows[q][rows[q] >= 0], *extra[q]])) for q in range(len(queries))]


def _finite(col: str) -> str:
    return f"{col} is not null and size({col}) > 0 and not exists({col}, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists({col}, x -> x <> 0)"


def _longer(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that makes them all as long as the longest."""
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))])


def _spread_points(sample: np.ndarray, n: int) -> np.ndarray:
    """n vectors of the sample, each the farthest from those before."""
    at, d = 0, np.full(len(sample), np.inf)
    out = []
    for _ in range(min(n, len(sample))):
        out.append(sample[at])
        d = np.minimum(d, np.sqrt(((sample - sample[at]) ** 2).sum(axis=1)))
        at = int(d.argmax())
        if d[at] <= SLACK:
            break
    return np.array(out)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows but its own id, by inner product in double
    precision, ties to the smaller id; all candidates if there are fewer.

    Vectors that are null, empty, zero or hold null or non-finite components take no part. Queries are compared with
    vectors of their own length. Rows of one id and vector count once. Null ids take no part; other columns are
    ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, 4096)
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(_finite("v")).where("id is not null").distinct()
    base, asked = pin(clean(vectors)), pin(clean(queries))
    stats = base.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("aggregate(v, 0d, (s, x) -> s + x * x)")).alias("norm")).orderBy("dim").collect()
    parts = [_nearest(base.where(F.size("v") == s["dim"]), asked.where(F.size("v") == s["dim"]), s["n"], s["norm"], k, factor) for s in stats]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest(base: DataFrame, queries: DataFrame, n: int, longest: float, k: int, factor: float) -> DataFrame:
    """The search among vectors of one length."""
    spark = base.sparkSession
    share = min(1.0, 4 * SAMPLE / n)
    rows = base.where(F.expr(f"pmod(xxhash64(id, 11), 1000000) < {int(1_000_000 * share)}")).orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").collect()  # bounded by SAMPLE
    points = _spread_points(_longer(np.array([r[0] for r in rows] or [base.select("v").first()[0]], float), longest), min(POINTS, -(-n // SHARD)))

    @F.pandas_udf("place int, far array<double>")
    def place(v: pd.Series) -> pd.DataFrame:
        d = _distances(_longer(np.stack(v.to_numpy()), longest), points) if len(v) else np.empty((0, len(points)))
        return pd.DataFrame({"place": d.argmin(axis=1) if len(v) else [], "far": list(d[:, :FAR])})

    placed = pin(base.withColumn("p", place("v")).select("id", "v", "p.place", "p.far"))
    counts = {r[0]: r[1] for r in placed.groupBy("place").agg(F.count(F.lit(1))).collect()}  # at most POINTS rows
    splits = {p: -(-c // SHARD) for p, c in counts.items()}
    # A place of more vectors than a shard holds is dealt by hash into as many shards as it needs.
    first = dict(zip(splits, np.cumsum([0, *splits.values()]).tolist(), strict=False))
    of = F.create_map(*[F.lit(x) for p in splits for x in (p, first[p])])
    into = F.create_map(*[F.lit(x) for p in splits for x in (p, splits[p])])
    shard = lambda salt: (of[F.col("place")] + F.pmod(F.xxhash64("id", F.lit(salt)), into[F.col("place")])).cast("int")
    indexed = placed.withColumn("shard", shard(0))

    def plant(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """The tree of a shard. Equal vectors are one point with all their ids, smallest first."""
        pdf = pdf.sort_values("id")
        v = np.stack(pdf["v"].to_numpy())
        _, at, inverse = np.unique(v, axis=0, return_index=True, return_inverse=True)
        ids, inverse = pdf["id"].to_numpy(), inverse.ravel()
        order = np.argsort(inverse, kind="stable")
        groups = np.split(ids[order], np.flatnonzero(np.diff(inverse[order])) + 1)
        x = _longer(v[at], longest)
        leaves, rows = build(x, np.random.default_rng(int(key[0])))
        far = np.stack(pdf["far"].to_numpy())
        blob = pickle.dumps((leaves, x[rows], [groups[i] for i in rows]), protocol=5)
        return pd.DataFrame({"shard": [key[0]], "tree": [blob], "low": [far.min(axis=0)], "high": [far.max(axis=0)]})

    index = pin(indexed.groupBy("shard").applyInPandas(plant, "shard int, tree binary, low array<double>, high array<double>"))
    ranges = index.select("shard", "low", "high").orderBy("shard").collect()  # at most POINTS rows and one for each SHARD vectors
    names = np.array([r["shard"] for r in ranges])
    low, high = (np.array([r[c] for r in ranges]) for c in ("low", "high"))

    def ask(key, mine: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        out_q, out_i, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(mine) and len(tree):
            leaves, x, groups = pickle.loads(tree["tree"].iloc[0])
            qv = np.stack(mine["v"].to_numpy())
            for at in range(0, len(qv), 1024):  # bounds what a call holds for all its queries and leaves
                q, v = mine["id"].to_numpy()[at : at + 1024], qv[at : at + 1024]
                # A query's own row may be among the nearest, hence one more.
                found = search(leaves, x, np.column_stack([v, np.zeros(len(v))]), k + 1, factor, mine["kth"].to_numpy()[at : at + 1024])
                for qid, w, rows in zip(q, v, found, strict=True):
                    s = np.einsum("ij,j->i", x[rows, :-1], w)
                    order = np.argsort(-s, kind="stable")
                    own = [groups[rows[j]][: k + 1] for j in order]  # k + 1 smallest ids of equal vectors are all that can count
                    ids, scores = np.concatenate([np.empty(0, np.int64), *own]), np.repeat(s[order], [len(o) for o in own])
                    ids, scores = ids[ids != qid], scores[ids != qid]
                    top = np.lexsort((ids, -scores))[:k]
                    out_q.append(np.full(len(top), qid)), out_i.append(ids[top]), out_s.append(scores[top])
        return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_i), "score": np.concatenate(out_s)})

    def answers(q: DataFrame, n_queries: int) -> DataFrame:
        blocks = max(1, -(-n_queries // BLOCK))
        q = q.withColumn("block", F.expr(f"cast(pmod(xxhash64(id, 7), {blocks}) as int)"))
        trees = index.select("shard", "tree", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        found = q.groupBy("shard", "block").cogroup(trees.groupBy("shard", "block")).applyInPandas(ask, "query_id long, vec_id long, score double")
        return found.distinct()

    total = queries.count()
    # A query's own length does not matter for the order, so it gets no coordinate more and its bounds stay valid.
    @F.pandas_udf("place int, far array<double>")
    def locate(v: pd.Series) -> pd.DataFrame:
        q = np.stack(v.to_numpy()) if len(v) else np.empty((0, points.shape[1] - 1))
        d = _distances(np.column_stack([q, np.zeros(len(q))]), points)
        return pd.DataFrame({"place": d[:, list(counts)].argmin(axis=1) if len(q) else [], "far": list(d[:, :FAR])})

    nth = F.element_at(F.array(*[F.lit(p) for p in counts]), F.col("l.place") + 1)
    located = pin(queries.withColumn("l", locate("v")).select("id", "v", nth.alias("place"), "l.far"))
    home = located.withColumn("shard", shard(1)).withColumn("kth", F.lit(float("inf")))
    near = answers(home.select("id", "v", "kth", "shard"), total)
    if len(names) > 1:
        near = pin(near)
        # k + 1 places, since the query's own row is left out; the distance follows from the inner product.
        worst = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s"))
        norm = F.expr("aggregate(v, 0d, (s, x) -> s + x * x)")
        kth = F.when(F.col("c") >= k, F.sqrt(F.greatest(norm + longest - 2 * F.col("s"), F.lit(0.0)) + SLACK)).otherwise(float("inf"))
        known = home.join(worst, home["id"] == worst["query_id"], "left").select("id", "v", "far", "shard", F.coalesce(kth, F.lit(float("inf"))).alias("kth"))

        @F.pandas_udf("array<int>")
        def visit(far: pd.Series, kth: pd.Series, own: pd.Series) -> pd.Series:
            d = np.stack(far.to_numpy()) if len(far) else np.empty((0, low.shape[1]))
            bound = np.zeros((len(d), len(names)))
            for j in range(d.shape[1]):
                bound = np.maximum(bound, np.maximum(low[None, :, j] - d[:, j, None], d[:, j, None] - high[None, :, j]))
            go = (bound * factor <= kth.to_numpy()[:, None] + SLACK) & (names[None] != own.to_numpy()[:, None])
            return pd.Series([names[g] for g in go])

        others = known.withColumn("shard", F.explode(visit("far", "kth", "shard"))).select("id", "v", "kth", "shard")
        near = near.union(answers(others, total)).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Vantage points to which shards know their distances.
FAR = 32


def op4(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
