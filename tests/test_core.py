from pyspark.sql import functions as F

from docstrata.functions import html, text as tx
from docstrata.operators import corpus as co


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_text_rules(spark):
    assert one(spark, tx.detect_language, "This and that") == "en" and one(spark, tx.detect_language, "dandan") == "en"
    assert [one(spark, tx.content_category, t) for t in ("apply now", "apply for benefits", "hello")] == ["application", "benefits", "contact"]
    assert one(spark, tx.completeness, "1/1/2024") == 0.5 and abs(one(spark, tx.completeness, "1/1/2024 2/2/2024") - 1 / 6) < 1e-12
    assert one(spark, lambda t: tx.sentence_chunks(t, 4), "Aa. Bb! Cc") == ["Aa. Bb", "Cc"]
    assert [one(spark, tx.expired_path, u) for u in ("/archive/x", "/report-2022", "/v2/api", "/services")] == [True, True, True, False]


def test_queue_and_robots(spark):
    rows = spark.createDataFrame([("E5 API error (502)", 0), ("E5 API error (502)", 2), ("bad input", 0)], "m string, a int")
    got = [(r.s.status, r.s.attempts) for r in rows.select(co.after_failure(F.col("m"), F.col("a")).alias("s")).collect()]
    assert got == [("pending", 1), ("failed", 2), ("failed", 0)]
    allowed = co.robots_allowed(F.col("t"), F.array(F.lit("/a")), F.array(F.lit("/a/b")))
    assert [one(spark, lambda t: allowed, p) for p in ("/a/x", "/a/b/c", "/A/x")] == [False, True, True]


def test_html():
    s = html.heading_sections("<h1>A</h1><p>x</p><h2>B</h2><p>y</p><h3>C</h3><p>z</p>")
    assert [(x["title"], x["parent_id"]) for x in s] == [("A", None), ("B", "section-1"), ("C", "section-1")]
    assert s[0]["content"] == "x\n\nB\n\ny\n\nC\n\nz"
    assert html.page_rules("<h2>Eligibility</h2><ul><li>a</li></ul>", "")["eligibility"] == ["a"]
    assert html.page_rules("<h2>Eligibility</h2><p>a</p>", "")["eligibility"] == []


def test_structure_and_chunks():
    page = "<html lang='ms'><title>T</title><h1>A</h1><p>x</p><h2>B</h2><p>y</p><h3>C</h3><p>z</p></html>"
    s = html.structure(page, "")
    assert (s["title"], s["language"], s["method"], s["total_sections"], s["max_depth"], s["structure_type"]) == ("T", "ms", "html-headings", 3, 2, "mixed")
    t = html.text_sections("TITLE: Aid\nhello world\n(a) who\n* point\n- other\n12")
    assert [(x["title"], x["level"], x["parent_id"]) for x in t][:3] == [("Aid", 1, None), ("ello world", 2, "section-1"), ("who", 3, "section-1")]
    assert t[2]["bullets"] == ["point", "other"] and t[3]["title"] == "2"
    assert html.structure("", "")["title"] == "Untitled Document" and html.structure("", "")["method"] == "hybrid"
    assert [c["text"] for c in html.plain_chunks("one two three. four five six")] == ["one two three four five six"]
    assert [(c["kind"], c["text"]) for c in html.plain_chunks("aa\n\nbb")] == [("paragraph", "aa\n\nbb")]
    two = html.plain_chunks("\n\n".join(["First words of it here. " + "a" * 1800, "b" * 900]))
    assert [c["overlap"] for c in two] == [False, False] and len(two) == 2 and two[0]["boundaries"] == []
    h = html.heading_chunks("<h2>How to apply</h2><p>" + "word " * 20 + "</p><h3>x</h3><h2>Fees</h2><p>1</p>")
    assert [(c["heading"], c["section_type"]) for c in h] == [("How to apply", "process")] and h[0]["text"].endswith("\nx")
    assert [c["text"] for c in html.token_chunks("Aa bb. Cc dd! Ee", 2, lambda x: len(x.split()))] == ["Aa bb.", "Cc dd!"]
    d = html.document_chunks("", "<h1>T</h1><p>" + "x" * 2500 + "</p>")
    assert [(c["start"], c["end"]) for c in d] == [(0, 1000), (900, 1900), (1800, 2500)]
    assert [c["text"] for c in html.document_chunks("a" * 600 + "\n\n" + "b" * 500)] == ["a" * 600, "a" * 100 + "b" * 500]


def test_cleaning():
    noise = "<div class='ads'>" + "ads " * 60 + "</div><p class='site-info'>info</p>"
    page = f"<html><title> T </title><body><div class='ad'>kept</div>{noise}<p>{'Real words. ' * 12}</p></body></html>"
    text, title, score, method, language, removed = html.clean(page)
    assert title == "T" and "ads" not in text and "kept" in text and score > 0 and removed >= 1 and language == ("ms" if method == "selectors" else "en")
    assert html.image_alts("<img alt='abcd'><img alt='abc'><img>") == ["abcd"]
    assert html.pagination_links("<a href='?page=2'>2</a><a href='https://x.org/a'>Next</a>" * 2, "https://x.org/a") == ["https://x.org/?page=2"]
    rules = html.page_rules("<h1>P</h1>", "x" * 200 + " Fee RM 10.50 due" + "y" * 200)
    assert rules["fee"] == "RM 10.50" and rules["fee_context"].startswith("x") and len(rules["fee_context"]) == 200


def test_lines_and_entities(spark):
    assert one(spark, tx.normalize, "Ministry of Health and more") == ""
    assert one(spark, tx.keywords, "The Big House and my Ministry; act lawful") == ["the big house", "ministry"]
    assert one(spark, lambda t: tx.normalization(t, ())["text"], "  Page 1\nx ") == "Page 1\nx"
    assert one(spark, tx.dedupe_lines, "aaa\nTerms and conditions\nTERMS AND CONDITIONS\nb\nb\n aaa ") == "aaa\nTerms and conditions\nb\nb"


def test_exactly_one(spark):
    import pytest

    df = spark.range(3)
    assert co.exactly_one(df.where("id = 1")).collect()[0].id == 1
    for bad in (df, df.limit(0)):
        with pytest.raises(Exception, match="expected one row"):
            co.exactly_one(bad).count()


def test_embedder_checks_its_length(spark):
    import pytest

    from docstrata.streaming import jobs

    df = spark.createDataFrame([("a b",), (None,)], "t string")
    assert [len(r.v) for r in df.select(jobs.embed("t").alias("v")).collect()] == [384, 384]
    with pytest.raises(Exception, match="other than 384"):
        df.select(jobs.embedder(384, lambda texts, n: [[1.0]] * len(texts))("t")).collect()


def test_tables():
    t = html.page_tables('<table><caption>Fees</caption><tr><th colspan="2">A</th><th>B</th></tr><tr><td><a href="/x">go</a></td><td><ul><li>a</li><li>b</li></ul></td><td><table><tr><td>in</td></tr></table></td></tr></table>')
    assert (t[0]["caption"], t[0]["headers"], t[0]["n_rows"], t[0]["kind"]) == ("Fees", ["A", "", "B"], 1, "nested")
    assert t[0]["rows"][0].split("\t")[:2] == ["go (/x)", "a; b"]
    assert html.page_tables("<table></table>") == []


def test_sync_actions(spark):
    old = spark.createDataFrame([(1, 0, "h1"), (1, 1, "h2"), (1, 2, "h3")], "d int, i int, chunk_hash string")
    new = spark.createDataFrame([(1, 0, "h1"), (1, 1, "hX")], "d int, i int, chunk_hash string")
    got = {r.i: r.action for r in co.sync_actions(new, old, ["d", "i"]).collect()}
    assert got == {0: "keep", 1: "update", 2: "delete"}
