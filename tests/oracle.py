"""Compare a query's rows with those of its DuckDB SQL: columns by name, rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if hasattr(x, "is_finite"):  # a decimal
        return round(float(x), 6)
    if hasattr(x, "isoformat"):
        return x.isoformat(" ") if hasattr(x, "hour") else f"{x.isoformat()} 00:00:00"
    return x


def rows(names: list[str], found: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both agree."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, got.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    apart = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(apart)} of {len(mine)} rows differ, first {apart[0]}" if apart else ""
