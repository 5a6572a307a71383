"""Named queries over the driver's tables, with their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; timestamps without a zone are read as UTC instants."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def _load() -> None:
    from confluo.plans import assembled, control, enriched, entities, evidence, kept, matching, pages, publishing, reads, refreshes, reports, restored, ruled, searching, shows, sources, stepping, users, validation  # noqa: F401  each registers its queries


def queries() -> dict[str, Query]:
    _load()
    return {name: f for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}
