"""Comparing a query with its SQL on the small tables."""

import glob
import os

import pandas as pd

FOLDER = "/root/testdata/sf0.001"


def connection():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


def _plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    return repr(round(float(x), 6)) if isinstance(x, float) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_plain, r)) for r in frame.itertuples(index=False, name=None))


def same(spark, con, query, sql):
    got, want = query(spark, FOLDER).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
