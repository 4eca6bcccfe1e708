"""Compares a query with its SQL on DuckDB, without order."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("QUERN_TESTDATA", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else round(x, 9)
    if isinstance(x, decimal.Decimal):
        return int(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def compare(spark, query, sql: str, data: str = DATA) -> int:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = query(spark, data)
    names = sorted(got.columns)
    want = con.execute(sql)
    order = [c[0] for c in want.description]
    assert sorted(order) == names
    a = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[order.index(c)]) for c in names) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    assert a == b
    return len(a)
