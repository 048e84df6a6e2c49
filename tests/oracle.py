"""Compare a query with its SQL on the same tables, as multisets of rounded rows."""

import os

import duckdb
import pandas as pd


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def _norm(df):
    def one(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, bool) or not hasattr(v, "__float__"):
            return str(v)
        return f"{float(v):.8g}"

    cols = sorted(df.columns)
    return sorted(tuple(one(v) for v in row) for row in df[cols].itertuples(index=False, name=None))


def same(spark, con, query, sql, sf):
    got, want = query(spark, sf).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _norm(got) == _norm(want)
