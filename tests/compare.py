"""Rows of a query and of its SQL in DuckDB, as the driver compares them."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted([plain(r[c]) for c in columns] for r in df.collect())


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted([plain(r[i]) for i in order] for r in cur.fetchall())
