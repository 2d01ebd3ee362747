"""Runs a query and its SQL on the same tables and compares all rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{sf_dir}/{t}.parquet') else ''}')")
    return con


def plain(v, digits=9):
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.{digits}g}" if v else "0"
    if isinstance(v, int):
        return f"{float(v):.{digits}g}" if abs(v) < 2**53 and digits < 15 else str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x, digits) for x in v])
    return str(v)


def rows(names, got, digits):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i], digits) for i in order) for r in got)


def compare(spark, query, sql, sf_dir, digits=9):
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect(), digits)
    con = duck(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, cur.fetchall(), digits)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b
    return got
