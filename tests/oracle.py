"""A query's rows against its SQL's, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return repr(round(float(x), 9))
    if isinstance(x, datetime.datetime) and x.time() == datetime.time():
        return str(x.date())
    return str(x)


def assert_same(df, sql: str, data: Path = DATA) -> None:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in data.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    other = con.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    order = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [other.columns.index(c) for c in order]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in other.fetchall())
    assert ours == theirs
