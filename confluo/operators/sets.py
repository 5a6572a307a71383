"""Set operations on rows and on keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with `change`: added or removed."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("removed")))


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ (a missing one differs from any): before, after."""
    joined = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full_outer")
    return joined.filter(~F.col("before").eqNullSafe(F.col("after")))


def layered(layers: list[DataFrame], keys: list[str], seq: str) -> DataFrame:
    """One row a key from the last layer that has it, there the last by `seq`."""
    rows = reduce(lambda a, b: a.unionByName(b), [x.withColumn("_layer", F.lit(i)) for i, x in enumerate(layers)])
    rest = [c for c in layers[0].columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest, F.col("_layer").alias("layer")), F.struct("_layer", seq)).alias("_r")).select(*keys, "_r.*")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], removed: DataFrame | None = None) -> DataFrame:
    """`table` without the keys of `rows` (and of `removed`), with `rows`."""
    rest = table.join(rows.select(*keys).distinct(), keys, "left_anti")
    if removed is not None:
        rest = rest.join(removed.select(*keys).distinct(), keys, "left_anti")
    return rest.unionByName(rows)


def unique_known(c: Column) -> Column:
    """The distinct values of a group that are neither null nor empty, sorted."""
    return F.array_sort(F.collect_set(F.nullif(c, F.lit(""))))
