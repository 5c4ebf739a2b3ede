"""Compares a registered query with its SQL on the same files."""

import decimal
import glob
import math
import os

import duckdb


def level(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(level, v))
    if getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    return v


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(folder + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(df, con, sql):
    columns = sorted(df.columns)
    ours = sorted((tuple(level(r[c]) for c in columns) for r in df.collect()), key=repr)
    con.execute(sql)
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(level(r[i]) for i in order) for r in con.fetchall()), key=repr)
    assert ours == theirs
