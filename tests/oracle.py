"""Comparison of a query's rows with DuckDB's over the same tables."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 8)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value if isinstance(value, (int, str, type(None))) else str(value)


def rows_of_duckdb(sql: str, folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return names, cursor.fetchall()


def check(frame, sql: str, folder: str):
    names, rows = rows_of_duckdb(sql, folder)
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    at = [names.index(c) for c in order]
    expected = sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    assert got == expected
