import textwrap

import duckdb

from docstrata.llm import licenses

APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"


def test_wrapped_notices_in_longer_files(spark):
    gpl, mit = licenses.TEMPLATES["GPL-3.0"][1], licenses.TEMPLATES["MIT"][1]
    code = [f"int value_{i} = compute({i});" for i in range(300)]
    comment = lambda t: [" * " + x for x in textwrap.wrap(t, 70)]
    files = {
        1: ["MIT License", "", "Copyright (c) 2020 Someone", "", *textwrap.wrap(mit, 80), "", *code],
        2: ["/*", " * Copyright 2020 Someone", *comment(APACHE), " *", *code],
        3: [*code[:50], "/*", " * File of a program", *comment(gpl)[:2], " *", *comment(gpl)[2:], " */", *code],
        4: code,
    }
    rows = [(i, "\n".join(x)) for i, x in files.items()] + [(5, None), (6, ""), (7, "\n \n"), (1, "\n".join(files[1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = licenses.scan(docs).collect()
    best = {}
    for r in sorted(out, key=lambda r: r.dice):
        best[r.doc_id] = (r.license, r.line)
    assert best == {1: ("MIT", 4), 2: ("Apache-2.0", 2), 3: ("GPL-3.0", 52)}
    assert all(r.n_lines > 1 for r in out if r.dice == 1.0)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows[:-1])
    want = con.execute(licenses.OP10_SQL).fetchall()
    assert sorted(tuple(r) for r in out) == sorted(want)
