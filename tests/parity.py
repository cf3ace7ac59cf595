"""Runs a query and its oracle over one folder of tables and compares rows, order aside."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb

from brindle.tables import NAMES


def connect(sf: str):
    con = duckdb.connect()
    for n in NAMES:
        if os.path.exists(f"{sf}/{n}.parquet"):
            con.execute(f"create view {n} as select * from read_parquet('{sf}/{n}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def compare(spark, con, sf: str, run, sql: str) -> str:
    """Empty if both agree."""
    df = run(spark, sf)
    cols = sorted(df.columns)
    a = [tuple(plain(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    b = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    a, b = sorted(a, key=repr), sorted(b, key=repr)
    for x, y in zip(a, b, strict=True):
        if x != y and not all(p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and math.isclose(p, q, rel_tol=1e-6, abs_tol=1e-6)) for p, q in zip(x, y, strict=True)):
            return f"{x} and {y}"
    return ""
