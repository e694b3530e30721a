"""Rows of a Spark query against rows of SQL on the same files."""

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

from brindle.tables import NAMES

DATA = "/root/testdata"


def oracle(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        path = f"{sf_dir}/{name}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def _plain(value):
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value


def rows(names: list[str], found) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in found)


def same(df, sf_dir: str, sql: str) -> None:
    names, want = oracle(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, df.collect()), rows(names, want)
    assert got == want, f"{list((got - want).items())[:5]} instead of {list((want - got).items())[:5]}"
