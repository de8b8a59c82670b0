import hashlib

from pyspark.sql import functions as F

from docstrata.llm.substring_dedup import dedup_passages, op6, remove_repeats


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, window):
    out = remove_repeats(df, window)
    return sorted((tuple(r) for r in out.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2(F.coalesce("repeats.kept", F.lit("")), 256)).collect()), key=str)


def test_real_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op6(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == brute(rows, 50)


def test_small_windows_and_odd_rows(spark):
    a = " ".join(f"w{i}" for i in range(40))
    rows = [(5, a), (3, "x y " + a[30:100] + " z"), (9, a + " " + a), (9, a + " " + a), (None, a), (7, None), (8, ""), (11, "one two"), (12, "ab " * 500), (13, "ab " * 300), (2, " ".join(f"w{i}" for i in range(7, 33)))]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, spans int, doc string").repartition(3)
    for window in (8, 9, 10):
        assert run(df, window) == brute(rows, window)
    assert dedup_passages(df, 8).columns == df.columns


def test_empty(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string"), 50) == []


def test_nothing_repeats(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(6)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 50) == brute(rows, 50)
