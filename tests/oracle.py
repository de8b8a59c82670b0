"""Comparison of a query's rows with its SQL on DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return str(x) if isinstance(x, (dict, list, tuple)) or hasattr(x, "isoformat") else x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def assert_equal(spark, query, sql: str, sf: str) -> None:
    df = query(spark, sf)
    got = _rows(df.columns, df.collect())
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    want = _rows([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
