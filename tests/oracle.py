"""Comparison of a query with its DuckDB SQL: columns by name, rows in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    kept = (tuple(plain(r[i]) for i in order) for r in rows)
    return [columns[i] for i in order], sorted(kept, key=lambda t: tuple((x is None, str(x)) for x in t))


def same(df, sql, sf_dir):
    found = connect(sf_dir).execute(sql)
    want = rows_of([c[0] for c in found.description], found.fetchall())
    got = rows_of(df.columns, df.collect())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b, (a, b)
