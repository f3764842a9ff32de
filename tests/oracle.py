"""Runs a query and its SQL twin and compares rows without regard to order."""

import decimal
import glob
import os

import duckdb


def tables(sf):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)


def sql_rows(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(norm(row[i]) for i in order) for row in r.fetchall()), key=repr)
