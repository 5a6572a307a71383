"""Faceted filters: conjunctive, each optional."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.operators.pairs import band_join


@dataclass
class Facets:
    """Values to filter by; what is empty filters nothing. Columns are named by `of`."""

    equal: dict[str, object] = field(default_factory=dict)
    among: dict[str, tuple] = field(default_factory=dict)
    between: dict[str, tuple] = field(default_factory=dict)
    text: str = ""
    text_columns: tuple[str, ...] = ()

    def condition(self) -> Column:
        out = F.lit(True)
        for c, v in self.equal.items():
            out = out & (F.col(c) == F.lit(v))
        for c, vs in self.among.items():
            out = out & F.col(c).isin(*vs)
        for c, (a, b) in self.between.items():
            out = out & F.col(c).between(F.lit(a), F.lit(b))
        if self.text:
            any_of = F.lit(False)
            for c in self.text_columns:
                any_of = any_of | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(self.text.lower()))
            out = out & any_of
        return out


def apply(df: DataFrame, facets: Facets) -> DataFrame:
    return df.filter(facets.condition())


def action_date(state: Column, start: Column, end: Column) -> Column:
    """Of a group of offers, an aggregate: the earliest end of those that are open, else the earliest start of those to come."""
    return F.coalesce(F.min(F.when(state == "open", end)), F.min(F.when(state == "not_started", start)))


def comparison_sets(asked: DataFrame, events: DataFrame, artists: DataFrame, days: int, n: int) -> DataFrame:
    """(k, other, place) for each of `asked`: the events of the same tour; without a tour, those that share an artist within
    `days`, the event itself first, then the `n` nearest, of equal ones the smaller k. Places are by day, then k.

    asked, events: k, day, tour; artists: k, artist, each pair once. Days meet through bins, so an artist with many events
    is not paired whole.
    """
    same = asked.filter("tour is not null").select("k", "tour").join(events.select(F.col("k").alias("other"), "tour", F.col("day").alias("other_day")), "tour").select("k", "other", "other_day")
    mine = asked.filter("tour is null").select("k", "day").join(artists, "k")
    theirs = events.select(F.col("k").alias("other"), F.col("day").alias("other_day")).join(artists.withColumnRenamed("k", "other"), "other")
    met = band_join(mine, theirs, "artist", "day", "other_day", days).select("k", "day", "other", "other_day").distinct()
    order = Window.partitionBy("k").orderBy(F.col("other") != F.col("k"), F.abs(F.datediff("other_day", "day")), "other")
    near = met.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).select("k", "other", "other_day")
    return same.unionByName(near).withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("other_day", "other"))).drop("other_day")
