"""Coverage, funnels, histograms and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.functions.status import percentage


def counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet each condition, in one pass."""
    return df.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])


def unpivot(df: DataFrame, name: str, value: str) -> DataFrame:
    """A row for each column: its name and value."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in df.columns])).alias("r")).select("r.*")


def coverage(df: DataFrame, **conditions: Column) -> DataFrame:
    """Per condition: covered, total, share (percent, one decimal)."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("covered"), F.col("_n").alias("total")) for k in conditions])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("share", percentage(F.col("covered"), F.col("total")))


def dense_histogram(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of every pair of values of two columns of few values, zeros included."""
    pairs = df.select(a).distinct().crossJoin(F.broadcast(df.select(b).distinct()))
    return pairs.join(df.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def zero_filled(dim: DataFrame, key: str, facts: DataFrame, fact_key: str) -> DataFrame:
    """Each row of a dimension with its number of facts, 0 if none."""
    n = facts.groupBy(F.col(fact_key).alias(key)).agg(F.count("*").alias("n"))
    return dim.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def delta(before: DataFrame, after: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Per metric: before, after, change, percent (null where before is 0)."""
    joined = before.select(metric, F.col(value).alias("before")).join(after.select(metric, F.col(value).alias("after")), metric, "full_outer")
    change = F.col("after") - F.col("before")
    return joined.withColumn("change", change).withColumn("percent", F.round(100.0 * change / F.nullif(F.col("before"), F.lit(0)), 1))


def latest_of(c: Column, fallback: Column) -> Column:
    """The latest valid moment of a group, else the fallback."""
    return F.coalesce(F.max(F.try_to_timestamp(c)), fallback)


def known_joined(c: Column, sep: str = ", ") -> Column:
    """The distinct known values of a group, in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(F.when(~c.isin("", "unknown"), c))), sep)


def exact_percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float], bins: int = 4096) -> DataFrame:
    """Per key the exact percentiles (interpolated between neighbours) of the finite values: a column for each of `shares`.

    Values are counted in bins of equal width; only the bins in which wanted ranks fall are looked at closer, as counts by
    value. So no task holds a key's values, however many rows or how unevenly they lie: a value that many rows share is one
    row by then.
    """
    v = F.col(value).cast("double")
    rows = df.select(F.col(key).alias("key"), v.alias("v")).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ends = rows.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    near = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    binned = rows.join(ends, "key").withColumn("bin", near)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("n") - 1)).alias("rank")) for name, p in shares.items()]))
    ranks = ends.select("key", wanted.alias("w")).select("key", "w.*").withColumns({"low": F.floor("rank"), "high": F.ceil("rank")})
    earlier = lambda keys, order: F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = binned.groupBy("key", "bin").agg(F.count("*").alias("c")).withColumn("before", earlier(["key"], "bin"))
    inside = lambda at: (F.col("before") <= F.col(at)) & (F.col(at) < F.col("before") + F.col("c"))
    chosen = counts.join(ranks, "key").filter(inside("low") | inside("high")).select("key", "bin", "before").distinct()
    close = binned.join(chosen, ["key", "bin"]).groupBy("key", "bin", "before", "v").agg(F.count("*").alias("c"))
    close = close.withColumn("before", F.col("before") + earlier(["key", "bin"], "v")).join(ranks, "key")
    found = close.groupBy("key", "name", "rank", "low").agg(F.max(F.when(inside("low"), F.col("v"))).alias("a"), F.max(F.when(inside("high"), F.col("v"))).alias("b"))
    each = found.withColumn("x", F.col("a") + (F.col("rank") - F.col("low")) * (F.col("b") - F.col("a")))
    return each.groupBy(F.col("key").alias(key)).agg(*[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in shares])


def batch_hash(df: DataFrame, key: str, id_col: str, width: int = 1000) -> DataFrame:
    """Per key: n, and a hash of its ids (whole numbers) in order: ids are joined and hashed by ranges of `width`, the hashes of
    ranges by `width` of them, then these. Every part that is joined is small, however many rows a key has."""
    joined = lambda order, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x["v"]), "|"), 256)
    low = df.groupBy(key, F.floor(F.col(id_col) / width).alias("a")).agg(F.count("*").alias("n"), joined(F.col(id_col).alias("o"), F.col(id_col).cast("string").alias("v")).alias("h"))
    high = low.groupBy(key, F.floor(F.col("a") / width).alias("b")).agg(F.sum("n").alias("n"), joined(F.col("a").alias("o"), F.col("h").alias("v")).alias("h"))
    return high.groupBy(key).agg(F.sum("n").alias("n"), joined(F.col("b").alias("o"), F.col("h").alias("v")).alias("batch_hash"))
