"""Running a query and its SQL over the same tables."""

import datetime
import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def tables(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def assert_same(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    places = [rel.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in places) for r in rel.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
