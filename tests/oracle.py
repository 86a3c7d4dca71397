"""Compares a query with its SQL: as multisets of rows, columns by name, numbers to six digits."""

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def difference(df, sql, c):
    """None, or what differs."""
    wanted = c.sql(sql)
    names = sorted(df.columns)
    if names != sorted(wanted.columns):
        return f"columns {names} and {sorted(wanted.columns)}"
    at = [wanted.columns.index(n) for n in names]
    a = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    b = Counter(tuple(plain(r[i]) for i in at) for r in wanted.fetchall())
    return None if a == b else f"{sum(a.values())} and {sum(b.values())} rows; only ours {list((a - b))[:3]}; only theirs {list((b - a))[:3]}"
