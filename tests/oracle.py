"""Compare a query with its SQL on one scale: rows, columns and values, whatever the order."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, name, root):
    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(root):
        where = f"{root}/{f}" + ("/*.parquet" if os.path.isdir(f"{root}/{f}") else "")
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{where}'")
    df = e.queries()[name](spark, root)
    cur = con.execute(e.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    expected, got = rows_of(names, cur.fetchall()), rows_of(df.columns, df.collect())
    extra, lost = got - expected, expected - got
    assert not extra and not lost, f"{name}: {sum(extra.values())} extra {list(extra)[:3]}, {sum(lost.values())} lost {list(lost)[:3]}"
    return sum(got.values())
