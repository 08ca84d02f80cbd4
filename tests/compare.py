"""Rows of Spark and DuckDB side by side."""

import glob
import math
import os
from numbers import Number

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(int(v)) if isinstance(v, Number) else str(v)


def rows(data, columns, wanted):
    at = [columns.index(c) for c in wanted]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=str)


def duck(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def agree(df, con, sql):
    wanted = sorted(df.columns)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == wanted
    assert rows([tuple(r) for r in df.collect()], df.columns, wanted) == rows(got.fetchall(), names, wanted)
