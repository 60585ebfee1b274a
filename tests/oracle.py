"""Rows of a query and of its SQL, in a form that can be compared."""

import glob
import math
import os

import duckdb


def tables(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else float(f"{v:.12g}")) if isinstance(v, float) else v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)


def sql_rows(c, sql):
    rel = c.sql(sql)
    names = list(rel.columns)
    return sorted(names), sorted((tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in rel.fetchall()), key=str)
