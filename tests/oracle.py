"""Compares registered queries with their SQL twins in DuckDB: rows as multisets, columns by name."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return round(float(x), 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def differences(spark, con, folder: str, name: str, f, sql: str) -> str:
    """An empty string, or what differs."""
    df = f(spark, folder)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    if got == want:
        return "" if got else "no rows"
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
