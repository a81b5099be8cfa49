"""Compare a query with its SQL in DuckDB over the small test tables."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return x
    if isinstance(x, int | float):
        return round(float(x), 5) + 0.0
    return str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(([plain(x) for x in r] for r in frame[columns].astype(object).values.tolist()), key=str)


def agree(spark, con, sf, query, sql):
    got, want = rows(query(spark, sf).toPandas()), rows(con.execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    off = [(a, b) for a, b in zip(got[1], want[1]) if a != b and not close(a, b)]
    assert not off, off[:3]


def close(a, b):
    return all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1.0, abs(x)) for x, y in zip(a, b))
