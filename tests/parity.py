"""Queries against their SQL over the same tables."""

import glob
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connection(directory):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in glob.glob(f"{directory}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def table_of(names, rows):
    order = sorted(names)
    return sorted(tuple(plain(r[names.index(c)]) for c in order) for r in rows)


def check(spark, con, query, sql, directory=SMALL):
    df = query(spark, directory)
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert table_of(df.columns, [tuple(r) for r in df.collect()]) == table_of(want.columns, want.fetchall())
