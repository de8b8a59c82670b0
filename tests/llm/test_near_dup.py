from docstrata.llm import near_dup
from docstrata.llm.near_dup import bayes_floor, dedup_documents, near_duplicates


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows, k=3, num=85, den=100):
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, id int") if len(rows[0]) == 4 else spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, k, num, den).collect()}
    want = brute([r[:2] for r in rows], k, num, den)
    assert got == want


def test_real_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)
    check(spark, rows, 5, 80)


def test_chained_and_large_groups(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(n, " ".join(base[:n % 30] + [f"x{n}"] + base[n % 30 + 1 :]), "clash", 1) for n in range(1, 90)]
    rows += [(200, None, None, None), (201, "", "", 2), (202, "A b", "", 2), (203, "a B", "", 2), (204, " \t\n", "", 2), (205, "long " * 30000, "", 2), (206, "long " * 20000, "", 2)]
    check(spark, rows)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    base = [f"w{i}" for i in range(40)]
    # One opening shared by all, so they meet in buckets, and tails that link them in several chains.
    rows = [(7 * n % 101, " ".join(base + [f"t{(n + j) // 2 % 37}x{(n + j) % 5}" for j in range(12)])) for n in range(101)]
    check(spark, rows, 2, 85)
    check(spark, rows, 3, 80)


def test_rows_of_one_id_with_different_texts(spark):
    a, b = ([f"{p}{i}" for i in range(60)] for p in "ab")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(b)), (7, " ".join([*a, "x"])), (9, " ".join([*b, "x"])), (3, " ".join([*b, "y"])), (None, " ".join(a)), (11, "c"), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(df, 3, 85, 100).collect())
    assert got == [(0, 58, 0, True), (3, 59, 3, True), (5, 58, 3, False), (5, 58, 3, False), (5, 58, 5, True), (7, 59, 5, False), (9, 59, 3, False), (11, 0, 11, True), (11, 1, 11, True)]
    left = dedup_documents(df.withColumn("text_key", df.doc_id), 3, 85, 100)
    assert left.columns == ["doc_id", "text", "text_key"]
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, " ".join(a)), (3, " ".join([*b, "y"])), (11, ""), (11, "c")]


def test_equal_rows_of_a_kept_id(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "g h i j k l")], "doc_id long, text string")
    assert sorted(r.doc_id for r in dedup_documents(df).collect()) == [1, 2]
    assert dedup_documents(df.limit(0)).count() == 0


def test_larger_tables_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, 3, 85)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_floor_rises_with_evidence():
    floor = bayes_floor(140, 0.85, 20)
    assert floor[-1][0] == 140 and 85 < floor[-1][1] < 119
