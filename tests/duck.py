"""Comparison of a query's rows with DuckDB's over the same tables."""

import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)


def rows_in(sql, folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    out = con.sql(sql)
    at = [out.columns.index(c) for c in sorted(out.columns)]
    return sorted(out.columns), sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=str)


def same(df, sql, folder):
    assert rows_of(df) == rows_in(sql, folder)
