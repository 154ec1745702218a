"""Runs a query and its SQL side by side and compares names, rows and values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)) if isinstance(v, (list, dict)) else "", repr(v)) for v in row)


def _plain(v):
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if isinstance(v, float) and v == int(v) if isinstance(v, float) and math.isfinite(v) else False:
        return float(v) + 0.0
    return v


def compare(df, con, sql: str) -> tuple[bool, str]:
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    rows = expected.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    order = sorted(names)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ours = [tuple(_plain(r[c]) for c in order) for r in df.collect()]
    where = [names.index(c) for c in order]
    theirs = [tuple(_plain(r[i]) for i in where) for r in rows]
    if len(ours) != len(theirs):
        return False, f"{len(ours)} rows vs {len(theirs)}"
    ours.sort(key=_key)
    theirs.sort(key=_key)
    for a, b in zip(ours, theirs):
        if a != b or any(type(x) is not type(y) for x, y in zip(a, b)):
            return False, f"{order}\n  spark {a}\n  sql   {b}\n  types {types}"
    return True, f"{len(ours)} rows"
