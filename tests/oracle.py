"""Compares a query with its SQL in DuckDB, order left aside, doubles to six digits."""

import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()

    def one(v):
        if v is None or (isinstance(v, (float, np.floating)) and np.isnan(v)):
            return None
        return f"{v:.6g}" if isinstance(v, (float, np.floating)) else str(v)

    for c in df.columns:
        df[c] = df[c].map(one).astype(object)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def check(found, want):
    a, b = canonical(found.toPandas()), canonical(want)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    assert a.equals(b), a[(a.fillna("~") != b.fillna("~")).any(axis=1)].head()
    return len(a)
