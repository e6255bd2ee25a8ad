"""Compare a registered query with its SQL in DuckDB, value by value, without regard to order."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connect(folder=DATA):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return c


def rows(df):
    def one(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or type(v).__module__ == "numpy":
            try:
                return repr(round(float(v), 6))
            except (TypeError, ValueError):
                return str(v)
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def check(spark, name, found, sql, folder=DATA):
    got = found[name](spark, folder).toPandas()
    want = connect(folder).execute(sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
