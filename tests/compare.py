"""Spark rows against DuckDB rows, without regard to order."""

import math
from collections import Counter

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def expected(sql, sf="sf0.001"):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names), rows(names, got.fetchall())


def check(spark, query, sql, sf="sf0.001"):
    df = query(spark, f"{DATA}/{sf}")
    names, want = expected(sql, sf)
    assert sorted(df.columns) == names
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == want, (sum(got.values()), sum(want.values()), list((got - want).items())[:3], list((want - got).items())[:3])
