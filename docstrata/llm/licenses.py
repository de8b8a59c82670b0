"""Licence notices by Dice coefficient over word bigrams, in DataFrame functions only.

Lines, runs of consecutive lines, and whole texts are normalised to words and compared with licence templates by
2 |A & B| / (|A| + |B|) over their sets of word bigrams. A pair can only reach a threshold t if |A| and |B| are within
a factor t / (2 - t), so templates of other sizes are pruned before anything is compared; and it shares at least that
part of the template's bigrams, so texts that have fewer of them anywhere are never cut into lines.
"""

from __future__ import annotations

import json
import math
import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices as published by the licences' authors; fixed values.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
THRESHOLD = 0.8


def _lines(text: Column) -> Column:
    """A text in lower-case words with one space between, its line breaks kept."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9\n]+", " "))


def _bigrams(w: Column) -> Column:
    """The set of word bigrams; none for fewer than two words."""
    pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
    return F.array_distinct(pairs)


def _hash(a: str, b: str) -> int:
    """The engine's xxhash64 of two strings."""
    h = xxhash.xxh64_intdigest(b.encode(), seed=xxhash.xxh64_intdigest(a.encode(), seed=42))
    return h - (1 << 64) if h >> 63 else h


def _sizes(threshold: float) -> tuple[float, float]:
    """Least and greatest size of a set, in sizes of the template."""
    return threshold / (2 - threshold), (2 - threshold) / threshold


def _most_words(threshold: float, largest: int) -> int:
    """Most words of a run: one more than the bigrams that the largest template allows."""
    return int(largest * _sizes(threshold)[1]) + 1


def templates(threshold: float = THRESHOLD, texts: dict[str, list[str]] | None = None) -> list[dict]:
    """The fixed list, or one given: license, template (name), size, need (fewest bigrams that a match shares),
    bigrams and their hashes. Templates of fewer than two words match nothing and are left out."""
    out = []
    for k, v in (texts or TEMPLATES).items():
        for n, t in enumerate(v):
            w = re.sub("[^A-Za-z0-9]+", " ", t).lower().split()
            pairs = list(dict.fromkeys(zip(w, w[1:], strict=False)))
            if pairs:
                out.append({"license": k, "template": f"{k}#{n}", "size": len(pairs), "need": math.ceil(_sizes(threshold)[0] * len(pairs) - 1e-9), "bigrams": [" ".join(p) for p in pairs], "hashes": [_hash(*p) for p in pairs]})
    return out


def _let(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """df with value as a column, evaluated once: the optimizer does not copy an exploded expression to its uses."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def _lets(df: DataFrame, values: dict[str, Column], *keep: str) -> DataFrame:
    """The same for several values that share their parts."""
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def scan(docs: DataFrame, threshold: float = THRESHOLD, texts: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each line the closest notice that begins there: doc_id, line (from 0), n_lines, license, template, dice; and
    one row with line -1 and n_lines 0 for a text of several lines that is a notice as a whole.

    A notice is a line or a run of lines, and some bigram that its template has begins in its first line. Lines without words (blank, or of comment marks only) are passed over and not counted by n_lines. A run of two or
    more lines has at most as many words as the largest template allows bigrams, and one. Of several notices at the
    threshold the one of the greatest dice counts, then the first by license, template and n_lines. Null, empty and
    one-word texts match nothing. Repeated rows of one id give each line once, the closest. An empty table gives no
    rows; other columns are ignored. The templates are a list kept in code and go along with the plan.
    """
    known = templates(threshold, texts)
    lo, hi = _sizes(threshold)
    cap = _most_words(threshold, max((t["size"] for t in known), default=0))
    every = sorted({h for t in known for h in t["hashes"]})
    table = F.from_json(F.lit(json.dumps(known)), "array<struct<license string, template string, size int, need int, bigrams array<string>, hashes array<bigint>>>")
    d = _let(docs.where(F.col(text_col).isNotNull()), "t", _lines(F.col(text_col)), F.col(id_col).alias("doc_id"))
    d = _let(d, "w", F.split("t", "[ \n]+"), "doc_id", "t")
    # The bigrams of templates that a text has anywhere, whatever its lines.
    d = _let(d, "m", F.array_distinct(F.filter(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1))), lambda h: h.isin(every))), "doc_id", "t").where(F.size("m") > 0)
    d = _let(d, "able", F.filter(table, lambda x: F.size(F.array_intersect(F.col("m"), x["hashes"])) >= x["need"]), "doc_id", "t").where(F.size("able") > 0)
    lines = F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.alias("line"), F.filter(F.split(x, " "), lambda w: w != "").alias("w")))
    d = _let(d, "ls", F.filter(lines, lambda x: F.size(x["w"]) > 0), "doc_id", "t", "able").select("doc_id", "ls", F.contains("t", F.lit("\n")).alias("several"), F.inline("able"))

    # Per line its words, and how many bigrams that begin there the template has.
    ahead = lambda i: F.coalesce(F.get(F.get("ls", i + 1)["w"], F.lit(0)), F.lit(""))
    count = lambda w: F.size(F.filter(F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.xxhash64(x, w[i + 1])), lambda h: F.array_contains("hashes", h)))
    shared = F.transform("ls", lambda x, i: F.struct(F.size(x["w"]).alias("n"), (count(x["w"]) + F.array_contains("hashes", F.xxhash64(F.element_at(x["w"], -1), ahead(i))).cast("int")).alias("hits")))
    template = ["doc_id", "license", "template", "size", "bigrams"]
    # Place -1 stands for the whole text. A set of n bigrams has at most n + 1 words, so a text of more distinct words
    # is out of the size bounds.
    few = F.col("several") & (F.size(F.array_distinct(F.flatten(F.transform("ls", lambda x: x["w"])))) <= hi * F.col("size") + 1)
    d = _let(d, "c", shared, *template, "need", "ls", few.alias("few"))
    begins = F.filter(F.transform("c", lambda x, i: F.when(x["hits"] > 0, i)), lambda i: i.isNotNull())
    begins = F.concat(F.when(F.col("few"), F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")), begins)
    d = d.select(*template, "need", "ls", "c", F.explode(begins).alias("i"))
    whole = F.col("i") == -1
    d = _let(d, "part", F.slice("c", F.greatest("i", F.lit(0)) + 1, cap), *template, "need", "ls", "i")
    # One line may have any number of words; longer runs go as far as the words allow.
    zero = F.struct(*[F.lit(0).alias(x) for x in ("words", "lines", "hits")])
    step = lambda s, x: F.when(s["words"] + x["n"] <= cap, F.struct((s["words"] + x["n"]).alias("words"), (s["lines"] + 1).alias("lines"), (s["hits"] + x["hits"]).alias("hits"))).otherwise(F.struct(F.lit(cap + 1).alias("words"), s["lines"].alias("lines"), s["hits"].alias("hits")))
    reach = F.aggregate("part", zero, step, lambda s: F.struct(F.greatest(s["lines"], F.lit(1)).alias("lines"), F.greatest(s["hits"], F.col("part")[0]["hits"]).alias("hits")))
    d = d.select(*template, "need", "ls", "i", "part", F.inline(F.array(reach))).where(whole | (F.col("hits") >= F.col("need")))
    enough = F.filter(F.sequence(F.lit(1), F.col("lines")), lambda n: F.aggregate(F.slice("part", F.lit(1), n), F.lit(0), lambda s, x: s + x["hits"]) >= F.col("need"))
    enough = F.when(whole, F.array(F.lit(0))).otherwise(enough)
    d = d.select(*template, F.when(whole, F.col("ls")).otherwise(F.slice("ls", F.greatest("i", F.lit(0)) + 1, F.col("lines"))).alias("ls"), F.explode(enough).alias("n_lines"))
    whole = F.col("n_lines") == 0
    unit = F.when(whole, F.col("ls")).otherwise(F.slice("ls", F.lit(1), F.col("n_lines")))
    d = d.select(*template, "n_lines", F.when(whole, F.lit(-1)).otherwise(F.col("ls")[0]["line"]).alias("line"), F.flatten(F.transform(unit, lambda x: x["w"])).alias("w"))
    units = _let(d, "b", _bigrams(F.col("w")), *template, "line", "n_lines")
    fit = units.where((F.size("b") >= lo * F.col("size")) & (F.size("b") <= hi * F.col("size")))
    dice = 2.0 * F.size(F.array_intersect("b", "bigrams")) / (F.size("b") + F.col("size"))
    hits = _let(fit, "dice", dice, "doc_id", "line", "n_lines", "license", "template").where(F.col("dice") >= threshold)
    best = hits.groupBy("doc_id", "line").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license", "template", "n_lines")).alias("m"))
    return best.select("doc_id", "line", "m.n_lines", "m.license", "m.template", F.round(-F.col("m.d"), 6).alias("dice"))


def op10(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    lo, hi = _sizes(THRESHOLD)
    cap = _most_words(THRESHOLD, max(t["size"] for t in templates()))
    values = ", ".join("('{}', '{}', '{}')".format(k, f"{k}#{n}", t.replace("'", "''")) for k, v in TEMPLATES.items() for n, t in enumerate(v))
    words = lambda c: f"list_filter(string_split(lower(regexp_replace({c}, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda y: y <> '')"
    return rf"""
WITH tt(license, template, t) AS (VALUES {values}),
x AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s, i: {{'line': i - 1, 'w': {words('s')}}}), lambda s: len(s.w) > 0) AS ls FROM documents WHERE text IS NOT NULL),
s0 AS (SELECT doc_id, ls[i:i + {cap} - 1] AS ls FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM x)),
s AS (SELECT doc_id, ls, len(list_filter(range(1, len(ls) + 1), lambda n: list_sum(list_transform(ls[1:n], lambda z: len(z.w))) <= {cap})) AS k FROM s0),
r AS (SELECT doc_id, CAST(ls[1].line AS INTEGER) AS line, ls, CAST(unnest(range(1, greatest(k, 1) + 1)) AS INTEGER) AS n_lines FROM s),
w AS (SELECT doc_id, line, n_lines, len(ls[1].w) AS f, flatten(list_transform(ls[1:n_lines], lambda z: z.w)) AS w FROM r
      UNION ALL SELECT doc_id, -1, 0, len(text), {words('text')} FROM documents WHERE contains(text, chr(10))),
b AS (SELECT doc_id, line, n_lines, list_transform(range(1, least(f + 1, len(w))), lambda i: w[i] || ' ' || w[i + 1]) AS fb,
             list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
tw AS (SELECT license, template, {words('t')} AS w FROM tt),
tb AS (SELECT license, template, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS tb FROM tw),
p AS (SELECT doc_id, line, n_lines, license, template, 2.0::DOUBLE * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice FROM b JOIN tb ON len(b) >= {lo} * len(tb) AND len(b) <= {hi} * len(tb) AND list_has_any(fb, tb)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license, template, n_lines) AS rn FROM p WHERE dice >= {THRESHOLD})
SELECT doc_id, line, n_lines, license, template, round(dice, 6) AS dice FROM o WHERE rn = 1
"""


OP10_SQL = _sql()
