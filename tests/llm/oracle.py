"""Rows of a registered query and of its SQL, for comparison."""

import glob
import os

import duckdb


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted(repr(tuple(r[k] for k in order)) for r in cur.fetchall())
