"""A query's rows against its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())


def rows_of_sql(c, sql):
    r = c.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(x) for x in cols]
    return cols, sorted(repr(tuple(norm(x[i]) for i in at)) for x in r.fetchall())
