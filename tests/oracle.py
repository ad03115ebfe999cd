"""Compares a query's rows with its SQL in DuckDB."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, list | tuple):
        return [norm(x) for x in v]
    return str(v)


def same(df, con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    assert names == sorted(df.columns)
    at = [rel.columns.index(c) for c in names]
    got = sorted(str([norm(r[c]) for c in names]) for r in df.collect())
    want = sorted(str([norm(r[i]) for i in at]) for r in rel.fetchall())
    assert got == want
