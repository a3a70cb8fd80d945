"""Rows of a DataFrame and of a DuckDB query over the same files, in one comparable form."""

import glob
import os

import duckdb


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    order = sorted(range(len(cur.description)), key=lambda k: cur.description[k][0])
    return sorted(repr(tuple(r[k] for k in order)) for r in cur.fetchall())
