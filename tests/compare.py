"""Row sets of Spark and DuckDB in one form."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "quantize"):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, 0 if isinstance(v, (int, float)) else 1, v if v is not None else 0) for v in r))


def spark_rows(df):
    names = sorted(df.columns)
    return names, in_order(tuple(map(plain, r)) for r in df.select(names).collect())


def duck_rows(sf, sql):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.sql(sql)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return [got.columns[i] for i in order], in_order(tuple(plain(r[i]) for i in order) for r in got.fetchall())
