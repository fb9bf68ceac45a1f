"""Compares a query's rows with those of its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


def same_rows(spark, query, sql: str, sf: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = query(spark, sf)
    got = df.collect()
    ran = con.execute(sql)
    names = [d[0] for d in ran.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = [[plain(r[names.index(c)]) for c in cols] for r in ran.fetchall()]
    have = [[plain(r[c]) for c in cols] for r in got]
    assert sorted(map(str, have)) == sorted(map(str, want))
