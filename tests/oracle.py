"""Compare a Spark result with DuckDB's, as the driver does."""

import glob
import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v.asDict().values())
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def assert_same(df, con, sql):
    (ca, a), (cb, b) = rows_of(df), rows_of_sql(con, sql)
    assert ca == cb
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b):
        assert x == y
