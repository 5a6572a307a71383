"""Latest, first and best rows per key, and top rows of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key by `order`. Spark keeps n rows a key on each side of the shuffle."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_nth") <= n).drop("_nth")


def latest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """One row a key: the latest by `at`, of equal ones the smallest `tie`. With a number as tie an aggregate, so rows combine
    before the shuffle; other ties can't be turned around, so the first row of each key is kept."""
    if not isinstance(df.schema[tie].dataType, NumericType):
        return per_key(df, keys, [F.col(at).desc_nulls_last(), F.col(tie).asc_nulls_last()])
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(at), (-F.col(tie)).alias("_tie"))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def keep_first(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row a key, the first by `seq`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*keys, "_r.*")


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row a key, the last by `seq`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*keys, "_r.*")


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def ranks_of_top(df: DataFrame, order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows with their positions; the window runs over those n alone."""
    return top(df, order, n).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def batch(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """All rows with `selected`: whether they are among the first n; equal rows are selected together. The place is looked up among n rows, not by a global window."""
    keys = df.columns
    chosen = df.orderBy(*order).limit(n).distinct().select(*[F.col(c).alias(f"_{c}") for c in keys])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return df.join(chosen.withColumn("_in", F.lit(True)), on, "left").select(*keys, F.coalesce("_in", F.lit(False)).alias("selected"))


def japanese(c: str) -> Column:
    """A sort key by Japanese collation."""
    return F.collate(F.col(c), "ja")
