"""Runs a query's SQL in DuckDB and compares rows without regard to their order."""

import decimal
import os

import duckdb
import numpy as np
import pandas as pd

DATA = "/root/testdata"


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(folder):
        c.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return c


def norm(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(map(norm, v.values())) + "}"
    if v is None or v is pd.NaT:
        return "None"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer, float, np.floating, decimal.Decimal)):
        return "None" if v != v else f"{float(v):.9g}"
    return str(v)


def rows(spark_df):
    cols = sorted(spark_df.columns)
    return cols, sorted(tuple(norm(v) for v in r) for r in spark_df.select([f"`{c}`" for c in cols]).collect())


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
