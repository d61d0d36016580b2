"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if Path(path).is_dir() else path}'")
    return db


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    if type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return x


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(db: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted((tuple(_plain(r[k]) for k in order) for r in got.fetchall()), key=repr)


def differences(df, db, sql: str) -> str:
    names, theirs = sql_rows(db, sql)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    ours = rows_of(df)
    if ours == theirs:
        return ""
    odd = [(a, b) for a, b in zip(ours, theirs) if a != b][:2]
    return f"{len(ours)} and {len(theirs)} rows; {odd}"
