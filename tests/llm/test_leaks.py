from docstrata.llm import decontaminate

ITEM_A, ITEM_B = [f"A{i}" for i in range(20)], [f"b{i}" for i in range(14)]


def test_a_leak_in_a_long_document_is_cut(spark):
    items = spark.createDataFrame([(1, " ".join(ITEM_A)), (2, " ".join(ITEM_B))], "item_id long, text string")
    fill = lambda n, p="w": " ".join(f"{p}{i}" for i in range(n))
    whole = f"{fill(900)}.\n{' '.join(ITEM_A).upper()}, \u00e9t\u00e9\n{fill(90, 'x')} !\n"
    nested = f"{fill(900)} {' '.join(ITEM_A[:10] + ITEM_B + ITEM_A[10:])} {fill(90, 'x')}"
    rows = [(1, whole), (2, nested), (3, fill(20) + " " + " ".join(ITEM_A)), (4, fill(30) + "\n"), (None, whole), (5, whole), (5, fill(10)), (6, None), (7, " ".join(ITEM_B) + "; " + fill(900) + "?")]
    docs = spark.createDataFrame([(i, t, len(t or ""), "s") for i, t in rows], "doc_id long, text string, n_chars long, source string")
    out = decontaminate.cut_contaminated(docs, items)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = sorted(((r.doc_id or 0, r.text or "", r.n_chars, r.source) for r in out.collect()))
    cut = f"{fill(900)}, \u00e9t\u00e9\n{fill(90, 'x')} !\n"
    want = [(0, cut), (1, cut), (2, f"{fill(900)} {fill(90, 'x')}"), (3, fill(20)), (4, fill(30) + "\n"), (5, cut), (5, fill(10)), (6, ""), (7, "; " + fill(900) + "?")]
    assert got == sorted((i, t, len(t), "s") for i, t in want)
    assert decontaminate.contamination(out, items).where("n_hit > 0").isEmpty()
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [(4, fill(30) + "\n"), (5, fill(10)), (6, "")]
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.drop_contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.drop_contaminated(docs.withColumn("text_key", docs.source), items).where("text_key = 's'").count() == 3


def test_given_documents_keep_no_window(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    before = decontaminate.contamination(docs, items)
    under = before.where("n_hit > 0").where(~decontaminate.is_contaminated()).count()
    out = decontaminate.drop_contaminated(docs, items)
    assert under > 0 and decontaminate.contamination(out, items).where("n_hit > 0").isEmpty()
    assert out.count() == before.where("n_hit = 0").count()
