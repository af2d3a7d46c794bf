"""Rows of a query and of its SQL in DuckDB, made comparable."""

import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(float(v)) else round(float(v), 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def _table(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def of_spark(df):
    return _table(df.columns, [tuple(r) for r in df.collect()])


def of_sql(sql, directory):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for p in glob.glob(f"{directory}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    return _table([c[0] for c in got.description], got.fetchall())
