"""Comparing a query with its SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(value):  # noqa: ANN001, ANN201
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns: list[str], records: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in records), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:  # noqa: ANN001
    """An empty text when both sides have the same columns and rows, else what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, df.collect()), rows(names, found.fetchall())
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows; only here {only_a}; only SQL {only_b}"
