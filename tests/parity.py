"""Rows of a query against those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(v)


def connect(folder: str):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def differences(spark, folder: str, f, sql: str):
    df = f(spark, folder)
    names = sorted(df.columns)
    ours = Counter(repr([plain(r[c]) for c in names]) for r in df.collect())
    cur = connect(folder).execute(sql)
    theirs_names = [c[0] for c in cur.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(c) for c in names]
    theirs = Counter(repr([plain(r[i]) for i in at]) for r in cur.fetchall())
    return list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
