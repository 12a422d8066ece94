"""Compare a Spark result with DuckDB SQL over the same parquet tables."""

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def rows(df):
    cols = sorted(df.columns)
    plain = lambda x: None if x is None or x is pd.NA or x != x else x.item() if hasattr(x, "item") else x
    return cols, sorted((tuple(plain(x) for x in r) for r in df[cols].itertuples(index=False)), key=repr)


def same(result, sql, sf=SF):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    a, b = rows(result.toPandas()), rows(con.sql(sql).df())
    assert a[0] == b[0]
    assert a[1] == b[1]
