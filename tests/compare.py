"""Order-free comparison of a Spark result with its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def database(folder=DATA):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    want = sorted(repr(tuple(r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())
    assert got == want
