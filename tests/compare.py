"""Rows of a query against its SQL in DuckDB, on the same Parquet tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def rows(columns: list[str], records: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in records)


def differences(df, sql: str, sf_dir: str) -> tuple[Counter, Counter, int]:
    """Rows of one side only, and the number of rows of the query."""
    con = connect(sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows(names, found.fetchall())
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    return got - want, want - got, sum(got.values())
