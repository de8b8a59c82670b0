"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Each benchmark window is a set of word shingles. Shingles are ordered by how rare they are in all documents; a window
can only be contained where its rarest shingle is, so that one is its necessary prefix. Documents meet the prefixes at
the places where they have them, the place and the document's length bound where the window could lie, and the words
there are compared exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, is_small, lookup_join, pin, unpin

SHINGLE = 5
#: Most shingles, and bytes of them, that are sent to every executor; more are joined by shuffle.
PREFIX_ROWS, PREFIX_BYTES = 500_000, 64_000_000
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The characters between words, of either case.
_BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; an empty array for null."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(low, _SPLIT), lambda w: w != "")


def _hash(at, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[at(j) for j in range(size)])


def _matches(docs: DataFrame, sizes: list[int], known: DataFrame, around: int, small: bool) -> DataFrame:
    """Each shingle of a size in sizes that known has by its hash h, with its document (tkey) and place pos, from one
    pass over the texts.

    Where known is broadcast, rows also carry the words near them, in which the shingle begins at `at`: `around` before
    the place and as many from it on, cut out after the join. Where it is too large for that, all places of all
    documents are shuffled, so they carry nothing but their hash.
    """
    rows = docs.select("tkey", "w", F.posexplode("w").alias("pos", "word"))
    one = [F.when(F.get("w", F.col("pos") + (n - 1)).isNotNull(), _hash(lambda j: F.get("w", F.col("pos") + j), n)) for n in sizes]
    rows = rows.withColumn("h", one[0] if len(one) == 1 else F.explode(F.array(*one))).where("h is not null")
    if not small:
        return pin(rows.select("tkey", "pos", "h").join(known.hint("merge"), "h"))
    begin = F.greatest(F.col("pos") - around, F.lit(0))
    return pin(rows.join(F.broadcast(known), "h").select("tkey", "pos", "h", F.slice("w", begin + 1, F.col("pos") - begin + around).alias("near"), (F.col("pos") - begin).alias("at")))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items (sorted array of the item ids as strings), hits
    (places of hit words from 0).

    A window is `window` consecutive words of an item, or all words of a shorter one; a document word inside any
    occurrence of a window is hit. Null and empty texts have no words and hit nothing; items without words have no
    window; null item ids are left out of items, though their windows hit. Repeated rows each get a row. Empty tables
    give no rows, or rows without hits. Other columns are ignored.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("tkey"), F.col(text_col).alias("text"))
    worded = d.select("tkey", words(F.col("text")).alias("w"))
    it = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text)).alias("iw")).where(F.size("iw") > 0)
    length = F.least(F.size("iw"), F.lit(window))
    spans = it.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("iw") - length + 1), lambda i: F.slice("iw", i, length))).alias("ww"))
    by_window = pin(spans.distinct().withColumn("win", F.xxhash64("ww")))
    # Windows of fewer words than a shingle have one shingle, all their words.
    one = by_window.select("win", "ww").distinct().withColumn("size", F.least(F.size("ww"), F.lit(SHINGLE)))
    sizes = sorted(r[0] for r in one.select("size").distinct().collect())  # at most SHINGLE values
    n_words = F.size(words(F.col("text"))).cast("long").alias("n_words")
    if not sizes:
        return d.select("doc_id", n_words, F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<int>").alias("hits"))
    cut = reduce(lambda c, n: c.when(F.col("size") == n, F.transform(F.sequence(F.lit(0), F.size("ww") - n), lambda i: F.struct(i.alias("off"), _hash(lambda j: F.get("ww", i + j), n).alias("h")))), sizes, F)
    tokens = pin(one.select("win", "ww", F.explode(cut).alias("t")).select("win", "ww", "t.off", "t.h"))

    known = pin(tokens.select("h").distinct())
    small = is_small(known, PREFIX_ROWS, PREFIX_BYTES)
    met = _matches(worded, sizes, known, window, small)
    counts = pin(met.groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    # A window with a shingle that no document has cannot occur; of the others the rarest shingle is the prefix.
    rated = tokens.join(counts, "h", "left")
    prefix = rated.groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "h", "ww")).alias("p")).where("p.n > 0")
    prefix = pin(prefix.select("win", F.col("p.h").alias("h"), F.col("p.off").alias("off"), F.col("p.ww").alias("ww"), F.size("p.ww").alias("len")))

    probes = met.join(F.broadcast(prefix) if is_small(prefix, PREFIX_ROWS, PREFIX_BYTES) else prefix.hint("merge"), "h").withColumn("first", F.col("pos") - F.col("off")).where("first >= 0")
    if small:
        # The words near a place reach at least as far as the window; a document that ends before it has fewer.
        fits = (F.col("at") >= F.col("off")) & (F.col("at") - F.col("off") + F.col("len") <= F.size("near"))
        found = probes.where(fits).where(F.slice("near", F.col("at") - F.col("off") + 1, F.col("len")) == F.col("ww"))
    else:
        # Places at which all shingles of the window are, then the words there, of those documents only.
        wanted = probes.select("tkey", "win", "first", "len").distinct()
        every = wanted.join(tokens.select("win", "off", "h"), "win").select("tkey", "win", "first", "len", (F.col("first") + F.col("off")).alias("pos"), "h")
        whole = every.join(met.distinct(), ["tkey", "pos", "h"]).groupBy("tkey", "win", "first", "len").agg(F.count(F.lit(1)).alias("n"))
        whole = whole.where(F.col("n") == F.col("len") - F.least("len", F.lit(SHINGLE)) + 1)
        whole = pin(whole.groupBy("tkey").agg(F.collect_list(F.struct("win", "first", "len")).alias("at")))
        read = lookup_join(worded, whole, "tkey", "inner").select("tkey", "w", F.explode("at").alias("a")).select("tkey", "a.*", F.slice("w", F.col("a.first") + 1, F.col("a.len")).alias("read"))
        found = lookup_join(read, pin(one.select("win", "ww")), "win", "inner").where(F.col("read") == F.col("ww"))
    found = pin(found.select("tkey", "win", "first", "len").distinct())
    unpin(met, counts, known, tokens, prefix)

    hit = found.select("tkey", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("len") - 1)).alias("p")).distinct()
    hit = hit.groupBy("tkey").agg(F.count(F.lit(1)).alias("n_hit"), F.sort_array(F.collect_list("p")).alias("hits"))
    which = lookup_join(found.select("tkey", "win").distinct(), pin(by_window.groupBy("win").agg(F.collect_set("item").alias("of"))), "win", "inner")
    which = which.groupBy("tkey").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("of")))).alias("items"))
    verdict = pin(hit.join(which, "tkey", "left"))
    out = lookup_join(d.select("doc_id", "tkey", n_words), verdict, "tkey", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("hits", F.array().cast("array<int>")).alias("hits"))


def is_contaminated() -> Column:
    """At least one hit word, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """text_key, hits of the different rows of docs that have hit words."""
    keyed = docs.select(_text_key(), "text")
    return pin(contamination(keyed, items, id_col="text_key").where("n_hit > 0").select(F.col("doc_id").alias("text_key"), "hits").distinct())


def _text_key() -> Column:
    return F.xxhash64("doc_id", "text").alias("text_key")


def _without(text: Column, hits: Column) -> Column:
    """A text without the words at the places hits (sorted, from 0) and the separators before them."""
    parts = F.regexp_extract_all(text, F.lit(f"[{_BETWEEN}]*+[^{_BETWEEN}]++|[{_BETWEEN}]++"), F.lit(0))
    first = F.filter(hits, lambda h, i: F.coalesce(F.get(hits, i - 1) != h - 1, F.lit(True)))
    last = F.filter(hits, lambda h, i: F.coalesce(F.get(hits, i + 1) != h + 1, F.lit(True)))
    s = F.struct(parts.alias("parts"), F.concat(F.array(F.lit(0)), F.transform(last, lambda h: h + 1)).alias("begin"), F.concat(first, F.array(F.size(parts))).alias("end"))
    kept = F.transform(F.array(s), lambda x: F.flatten(F.transform(x["begin"], lambda b, i: F.slice(x["parts"], b + 1, F.greatest(F.get(x["end"], i) - b, F.lit(0))))))
    return F.array_join(F.get(kept, F.lit(0)), "")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without any benchmark window, with the columns they had, whatever their names.

    Each row is judged by its own text: a row with a hit word goes, however long it is, whether its id is null or
    has other rows; equal rows get equal answers. Rows with null or empty texts stay. An empty table gives no rows,
    and an empty benchmark, or one without words, drops none. cut_contaminated() keeps such rows and cuts them.
    """
    key = free_name(docs.columns, "text_key")
    bad = _hits(docs, items).select(F.col("text_key").alias(key))
    return lookup_join(docs.withColumn(key, _text_key()), pin(bad), key, "left_anti").select(*docs.columns)


def cut_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs with the columns they had, whose texts have lost all hit words; n_chars follows a changed text.

    As what is left may close up to a window, changed rows are looked at again until none has a hit. Rows without
    hits, and those with null or empty texts, are unchanged; empty tables are as for drop_contaminated().
    """
    found = _hits(docs, items)
    while not found.isEmpty():
        key, hits = free_name(docs.columns, "text_key"), free_name(docs.columns, "hits")
        table = pin(found.select(F.col("text_key").alias(key), F.col("hits").alias(hits)))
        rows = lookup_join(docs.withColumn(key, _text_key()), table, key, "left")
        changed = F.col(hits).isNotNull()
        text = F.when(changed, _without(F.col("text"), F.col(hits))).otherwise(F.col("text"))
        new = {"text": text}
        if "n_chars" in docs.columns:
            new["n_chars"] = F.when(changed, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        docs = pin(rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns]))
        found = _hits(docs, items)
    return docs


def op3(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contamination(docs, items)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
