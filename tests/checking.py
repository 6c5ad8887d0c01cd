"""Compares a query's rows with those of its SQL."""

import datetime
import glob
import math
import os

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.7g}")
    if isinstance(v, datetime.datetime):
        return v.date() if v.time() == datetime.time() else v
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def assert_same(query, sql, spark, sf_dir):
    got, want = rows_of(query(spark, sf_dir)), sql_rows(sql, sf_dir)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
