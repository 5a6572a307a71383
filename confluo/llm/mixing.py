"""Mixing sources to target weights by capped water-filling, in DataFrame operations alone.

Each source has a size, a weight and a cap (so many times its size). All sources rise together in proportion to their
weights until one meets its cap; what it can't hold is shared by the others, by weight, until none is above. With
ratios cap / weight in rising order, the level is (budget - caps of those already full) / (weights of the rest), for the
first source whose ratio is at least that level. Sums along an order are taken range by range, so no task holds all sources.

A source's target is then sampled: every document is repeated whole as often as the target allows for all, and what is
left goes to documents in a seeded order, the last of which may be taken in part. Where the rest runs out is found by
sums over bins of that order, bins of bins, and at last over rows that share place, id and size; these are ranked in
parts. So no source is ever sorted or summed in one task, whether ids repeat, are missing, or rows are copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, hinted, stash

BINS, PARTS = 4096, 64
WORD = "[^\\x20\\x09-\\x0D]+"
Stash = Callable[[DataFrame, str], DataFrame]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], keep: Stash) -> DataFrame:
    """`rows` with each of `sums` over the rows before it in `order`: within ranges of the order, and over whole ranges before."""
    placed = keep(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    ranges = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])  # a row a task
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in sums])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = {k: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_{k}") for k, c in sums.items()}
    return placed.join(F.broadcast(ranges), "_range").withColumns(own).drop("_range", *[f"_{k}" for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget_share: float, max_epochs: float, keep: Stash) -> DataFrame:
    """Per source (by code point, null last): source, source_size, weight (the given ones, repeating), target. sizes: source, size."""
    per = keep(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-per")
    per = running(per, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, keep)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).withColumns({"cap": cap, "ratio": cap / F.col("weight")})
    per = keep(running(per, [F.col("ratio"), F.col("rank")], {"caps": F.col("cap"), "weights": F.col("weight")}, keep), "mix-rising")
    whole = per.agg((F.sum("source_size") * F.lit(float(budget_share))).alias("budget"), F.sum("weight").alias("all_weights"))  # a single row
    level = (F.col("budget").cast("double") - F.col("caps")) / (F.col("all_weights") - F.col("weights"))
    levels = per.crossJoin(F.broadcast(whole)).withColumn("level", level)
    chosen = levels.agg(F.coalesce(F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level")))["level"], F.lit(float("inf"))).alias("chosen"))
    return per.crossJoin(F.broadcast(chosen)).select("source", "source_size", "weight", F.least(F.col("cap"), F.col("weight") * F.col("chosen")).alias("target"))


def boundary(sums: DataFrame, left: str, by: list[str]) -> DataFrame:
    """Per source the group (by the columns `by`) in which `left` words run out, as `<column>_at`, and how many are left before
    it, as `<first column>_left`. sums: a row per source and group, of at most BINS groups or of rows of one small bin."""
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source_no").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = sums.withColumn("_before", before).filter((F.col("_before") <= F.col(left)) & (F.col(left) < F.col("_before") + F.col("words")))
    return found.select("source_no", *[F.col(c).alias(f"{c}_at") for c in by], (F.col(left) - F.col("_before")).alias(f"{by[0]}_left"))


def with_sources(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    right = hinted(sources.withColumnRenamed("source", "_source"), n)
    return rows.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def plan(sizes: DataFrame, weights: tuple[int, ...], budget_share: float, max_epochs: float, keep: Stash) -> tuple[DataFrame, int]:
    """Per source its target, whole repeats, and where the rest runs out: at a place, id and size (`*_at`), with place_left
    words for the rows that have these; and the number of sources. sizes: id, source, size, place."""
    per = source_targets(sizes, weights, budget_share, max_epochs, keep)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per = per.withColumn("repeats", repeats).withColumn("left", F.floor("target").cast("long") - F.col("repeats") * F.col("source_size"))
    per = keep(per.withColumn("source_no", F.monotonically_increasing_id()), "mix-sources")
    n = per.count()
    bin1, bin2 = F.shiftright("place", 36), F.shiftright("place", 24) % BINS
    sums = with_sources(sizes, per, n).groupBy("source_no", "left", bin1.alias("bin1")).agg(F.sum("size").alias("words"))
    per = keep(per.join(boundary(sums, "left", ["bin1"]), "source_no", "left"), "mix-bin1")
    within = with_sources(sizes, per, n).filter(bin1 == F.col("bin1_at"))
    sums = within.groupBy("source_no", "bin1_left", bin2.alias("bin2")).agg(F.sum("size").alias("words"))
    per = keep(per.join(boundary(sums, "bin1_left", ["bin2"]), "source_no", "left"), "mix-bin2")
    within = with_sources(sizes, per, n).filter((bin1 == F.col("bin1_at")) & (bin2 == F.col("bin2_at")))
    sums = within.groupBy("source_no", "bin2_left", "place", "id", "size").agg(F.sum("size").alias("words"))
    return keep(per.join(boundary(sums, "bin2_left", ["place", "id", "size"]), "source_no", "left"), "mix-boundary"), n


def at_boundary(size: Column) -> Column:
    """Whether a row is one of those among which its source's rest runs out."""
    return F.coalesce((F.col("place") == F.col("place_at")) & F.col("id").eqNullSafe(F.col("id_at")) & (size == F.col("size_at")), F.lit(False))


def before_boundary(size: Column) -> Column:
    """Whether a row comes before them, in the order of place, id (null first) and size."""
    same = F.col("place") == F.col("place_at")
    id_before = F.coalesce(F.col("id") < F.col("id_at"), F.col("id").isNull() & F.col("id_at").isNotNull())
    return F.coalesce((F.col("place") < F.col("place_at")) | (same & (id_before | (F.col("id").eqNullSafe(F.col("id_at")) & (size < F.col("size_at"))))), F.lit(False))


def ranked_ties(rows: DataFrame, keep: Stash) -> DataFrame:
    """`rows` (source_no, h, ...) with rank: 0, 1, ... in each source, by the hash h of the text. Copies, which are all the
    same, are ranked in PARTS parts side by side."""
    rows = keep(rows.withColumn("_row", F.monotonically_increasing_id()), "mix-ties")
    group = F.pmod("h", F.lit(BINS))
    rows = rows.withColumns({"_group": group, "_part": F.pmod("_row", F.lit(PARTS))})
    counts = keep(rows.groupBy("source_no", "_group", "h", "_part").agg(F.count("*").alias("_n")), "mix-tie-counts")
    over = lambda keys, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("source_no", "_group").agg(F.sum("_n").alias("_n")).select("source_no", "_group", over(["source_no"], ["_group"]).alias("_earlier"))
    before = counts.withColumn("_within", over(["source_no", "_group"], ["h", "_part"])).join(groups, ["source_no", "_group"])
    before = before.select("source_no", "_group", "h", "_part", (F.col("_within") + F.col("_earlier")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("source_no", "_group", "h", "_part").orderBy("_row")) - 1
    return rows.withColumn("_own", own).join(before, ["source_no", "_group", "h", "_part"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_group", "_part", "_row")


def keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """id, source, text, place (48 bits of md5("seed:id")) and h (a hash of the text), with `more`: names of our own alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))).cast("binary"))
    place = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), text.alias("text"), place.alias("place"), F.xxhash64(text).alias("h"), *more)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget_share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, size (words), source_size, target, repeats (whole ones), extra (words of one more, the whole or a part), taken.

    taken = repeats * size + extra, so a source's taken words sum to its target, rounded down to whole words. The order
    of extras is that of 48 bits of md5("seed:id"), ties by id and size, then by a hash of the text; rows that are alike in
    all that are interchangeable. Null text: size 0, takes nothing. A null source is a source of its own, the last.
    Sources without words have target 0. Repeated rows are documents of their own. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    with Workspace(docs.sparkSession) as keep:
        sizes = stash(keyed(docs, seed, id_col, text_col, source_col).withColumn("size", word_count(F.col("text"))).drop("text"), "mix-sizes")
        per, n = plan(sizes, weights, budget_share, max_epochs, keep)
        per = stash(per, "mix-result")
        rows = with_sources(sizes, per, n)
        size, tied = F.col("size"), at_boundary(F.col("size"))
        ties = ranked_ties(rows.filter(tied), keep)
        ties = ties.withColumn("extra", F.greatest(F.lit(0), F.least(size, F.col("place_left") - F.col("rank") * size)).cast("long"))
        out = rows.filter(~tied).withColumn("extra", F.when(before_boundary(size), size).otherwise(F.lit(0)).cast("long")).unionByName(stash(ties.drop("rank"), "mix-tied"))
        return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "repeats", "extra", (F.col("repeats") * F.col("size") + F.col("extra")).alias("taken"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget_share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, all columns, each as often as `mix` takes it; one that is taken in part comes whole.

    Every row is decided by itself, also of several that share an id; nothing is known of a row but its place in the order
    and where its source's rest runs out, so texts are not shuffled. Nulls, repeated rows and empty tables are as in `mix`; columns may
    have any names.
    """
    with Workspace(docs.sparkSession) as keep:
        own = keyed(docs, seed, id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        size = word_count(F.col("text"))
        per, n = plan(keep(own.select("id", "source", size.alias("size"), "place"), "mix-sizes"), weights, budget_share, max_epochs, keep)
        rows = with_sources(own, stash(per, "mix-result"), n)
        ties = ranked_ties(rows.filter(at_boundary(size)), keep)
        more = F.when(F.col("rank") * F.col("size_at") < F.col("place_left"), 1).otherwise(0)
        ties = stash(ties.select("row", (F.col("repeats") + more).cast("int").alias("times")), "mix-tied")
        some = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
        rest = rows.filter(~at_boundary(size)).select("row", (F.col("repeats") + F.when(some & before_boundary(size), 1).otherwise(0)).cast("int").alias("times"))
        return rest.unionByName(ties).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
