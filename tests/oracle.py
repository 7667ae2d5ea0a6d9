"""Runs registered queries against DuckDB on the same tables and compares rows."""

from __future__ import annotations

import decimal
import glob
import math
import os
import time


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.6f}"
    return f"{type(v).__name__}:{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, fn, sql):
    """(ok, message) for one query; seconds in the message."""
    start = time.time()
    df = fn(spark, folder)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return False, f"{took:6.2f}s rows={len(got)} (no oracle)"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, f"{took:6.2f}s rows={len(a)}"
    in_a, in_b = set(a), set(b)
    extra = [x for x in a if x not in in_b][:2]
    lack = [x for x in b if x not in in_a][:2]
    return False, f"{took:6.2f}s spark={len(a)} duck={len(b)} columns={sorted(names)}\n  only spark {extra}\n  only duck  {lack}"
