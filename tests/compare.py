"""Comparison of a query's rows with its SQL in DuckDB, columns and rows in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


def rows_of(cols, rows):
    return sorted(tuple(normal(v) for v in r) for r in rows)


def check(df, con, sql):
    got = df.collect()
    rel = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    order = [rel.columns.index(c) for c in cols]
    assert not [t for t in map(str, rel.types) if "HUGE" in t]
    want = rows_of(cols, ([r[i] for i in order] for r in rel.fetchall()))
    assert rows_of(cols, ([r[c] for c in cols] for r in got)) == want
    return len(want)
