"""Comparison of a query with its SQL on the same files."""

import os

import duckdb
import pandas as pd


def _plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, bool) or type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    try:
        return repr(round(float(x), 9)) if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def canonical(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return list(df.columns), sorted(tuple(_plain(x) for x in r) for r in df.astype(object).itertuples(index=False, name=None))


def connect(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    return con


def assert_same(spark, folder, query, sql):
    got = canonical(query(spark, folder).toPandas())
    want = canonical(connect(folder).execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
