"""Search by approximate substrings over several weighted fields.

A pattern matches a field if it occurs in it with few errors (edits), counted as a share of its length. An error spoils two of a
pattern's pairs of neighbouring characters at most, so texts that hold too few of them are passed over; the others are compared,
by bit-parallel edit distance. Patterns and texts meet in tiles, a block of one against a block of the other, so no list of pairs
is shuffled; the work is distinct patterns times distinct texts. Equal patterns are asked and equal texts compared once, however
many queries and items bear them. A longer pattern is compared in stretches of 32 characters.

An item's score is the product of its matching fields' scores, each to the power of the field's share of all weights and its
norm (shorter fields count more); lower is better, 0.001 the least of a field that is not the pattern itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.functions import text

#: Characters of a stretch, the least score of a match, and that of a field equal to the pattern.
STRETCH, LEAST, EQUAL = 32, 0.001, 2.220446049250313e-16
#: Patterns and texts of a tile, buckets of pairs of characters, and characters of a block of texts.
PATTERNS, TEXTS, BUCKETS, CELLS = 1024, 8192, 2048, 2_000_000
#: Decimals of a score; ties go by `seq`.
DIGITS = 9


def normal(c: Column) -> Column:
    """Lower case, trimmed, katakana as hiragana; null: empty."""
    return text.fold_kana(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)^\s+|\s+$", ""))


def field_rows(items: DataFrame, fields: Mapping[str, float], item: str = "id") -> DataFrame:
    """item, seq, text, power: a row for each field of each item, and for each member of a list. items: id, seq, the fields."""
    total, out = sum(fields.values()), None
    for name, weight in fields.items():
        value = F.explode(name) if items.schema[name].dataType.typeName() == "array" else F.col(name)
        rows = items.select(F.col(item).alias("item"), "seq", value.alias("v"))
        norm = F.round(1 / F.sqrt(F.greatest(F.lit(1), F.regexp_count("text", F.lit("[^ ]+")))), 3)
        rows = rows.select("item", "seq", normal(F.col("v")).alias("text")).filter("text <> ''").withColumn("power", F.lit(weight / total) * norm)
        out = rows if out is None else out.unionByName(rows)
    return out


def most_errors(length: Column, threshold: float) -> Column:
    """The most errors e with e / length <= threshold."""
    return F.floor(F.lit(threshold) * length + 1e-9).cast("int")


def stretches(queries: DataFrame, threshold: float) -> DataFrame:
    """query, whole (the normal pattern), pattern, k, n: each pattern in stretches; the last one reaches back to be whole."""
    q = queries.select("query", normal(F.col("pattern")).alias("whole")).filter("whole <> ''")
    length = F.char_length("whole")
    n = F.ceil(length / STRETCH).cast("int")
    start = lambda i: F.greatest(F.lit(0), F.least(i * STRETCH, length - STRETCH))
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("whole"), start(i) + 1, F.lit(STRETCH)))
    rows = q.select("query", "whole", n.alias("n"), F.explode(parts).alias("pattern"))
    return rows.withColumn("k", most_errors(F.char_length("pattern"), threshold))


def encoded(texts: list[str]) -> np.ndarray:
    """The code points of texts, a column each; shorter ones end in zeros."""
    codes = np.zeros((max(map(len, texts), default=0), len(texts)), np.uint32)
    for i, t in enumerate(texts):
        codes[: len(t), i] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return codes


def distances(pattern: str, texts: list[str]) -> np.ndarray:
    """The least edits that make the pattern a substring of each text."""
    return measured(pattern, encoded(texts))


def measured(pattern: str, codes: np.ndarray) -> np.ndarray:
    """As `distances`, of texts as `encoded`. Bit-parallel: a word holds a column of the table of distances, and all texts step
    together."""
    m, n = len(pattern), codes.shape[1]
    one, high = np.uint64(1), np.uint64(1 << (m - 1))
    up, down = np.full(n, (1 << m) - 1, np.uint64), np.zeros(n, np.uint64)
    score = np.full(n, m)
    best = score.copy()
    places = {c: np.uint64(sum(1 << j for j, x in enumerate(pattern) if x == c)) for c in set(pattern)}
    for column in codes:
        equal = np.zeros(n, np.uint64)
        for c, bits in places.items():
            equal[column == ord(c)] = bits
        across = (((equal & up) + up) ^ up) | equal
        plus, minus = down | ~(across | up), up & across
        score += ((plus & high) != 0).astype(int) - ((minus & high) != 0).astype(int)
        plus, minus = plus << one, minus << one
        up, down = minus | ~(equal | down | plus), plus & (equal | down)
        best = np.minimum(best, score)
    return best


def pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Buckets of pairs of neighbouring characters; pairs that share one only let more texts through."""
    return (first.astype(np.uint64) * np.uint64(2654435761) + second.astype(np.uint64) * np.uint64(40503) >> np.uint64(5)) % np.uint64(BUCKETS)


class Block:
    """Texts with their code points, and for each bucket of pairs which texts hold one of it."""

    def __init__(self, texts: list[str]):
        self.texts, self.codes = texts, encoded(texts)
        self.held, at = np.zeros((BUCKETS, len(texts)), np.uint8), np.arange(len(texts))
        lengths = np.array([len(t) for t in texts])
        for j in range(len(self.codes) - 1):
            long = lengths > j + 1
            self.held[pairs(self.codes[j], self.codes[j + 1])[long], at[long]] = 1

    def near(self, pattern: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of texts that hold the pattern with at most k errors, and those errors."""
        own, least = np.frombuffer(pattern.encode("utf-32-le"), np.uint32), len(pattern) - 1 - 2 * k
        at = np.arange(len(self.texts))
        if least > 0:
            at = at[np.add.reduce(self.held[pairs(own[:-1], own[1:])], axis=0, dtype=np.uint8) >= least]
        errors = measured(pattern, self.codes[:, at]) if len(at) else at
        return at[errors <= k], errors[errors <= k]


def blocks(texts: list[str]) -> list[Block]:
    """Texts by length, in blocks of at most CELLS characters, padding included."""
    texts, out, start = sorted(texts, key=len), [], 0
    for i in range(1, len(texts) + 1):
        if i == len(texts) or (i + 1 - start) * len(texts[i]) > CELLS:
            out.append(Block(texts[start:i]))
            start = i
    return out


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What matches within each tile. Rows come by tile, texts (k is null) before patterns."""
    tile, texts, own = None, [], None
    for x in batches:
        found: tuple[list, list, list] = ([], [], [])
        for p, t, value, k in zip(*(x.column(c).to_pylist() for c in ("p", "t", "value", "k")), strict=True):
            if tile != (p, t):
                tile, texts, own = (p, t), [], None
            if k is None:
                texts.append(value)
                continue
            if own is None:
                own = blocks(texts)
            for block in own:
                at, errors = block.near(value, k)
                found[0].extend([value] * len(at))
                found[1].extend(block.texts[i] for i in at)
                found[2].extend(errors.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int32())], ["pattern", "text", "errors"])


def tiles(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(p, t, value, k): every block of patterns beside every block of texts. patterns: pattern, k; texts: text; both distinct."""
    n_p, n_t = (max(1, -(-df.count() // most)) for df, most in ((patterns, PATTERNS), (texts, TEXTS)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = patterns.select(block("pattern", n_p).alias("p"), each(n_t).alias("t"), F.col("pattern").alias("value"), "k")
    there = texts.select(each(n_p).alias("p"), block("text", n_t).alias("t"), F.col("text").alias("value"), F.lit(None).cast("int").alias("k"))
    return there.unionByName(asked).repartition(n_p * n_t, "p", "t").sortWithinPartitions("p", "t", F.col("k").asc_nulls_first())


def matches(queries: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """query, item, seq, score: all items that match. queries: query, pattern (an empty one finds nothing); rows: as of field_rows."""
    parts = stretches(queries, threshold)
    found = tiles(parts.select("pattern", "k").distinct(), rows.select("text").distinct()).mapInArrow(compared, "pattern string, text string, errors int")
    share = F.greatest(F.lit(LEAST), F.col("errors") / F.char_length("pattern"))
    per = parts.join(found, "pattern").groupBy("query", "whole", "n", "text").agg(F.sum(share).alias("s"), F.count("*").alias("hits"))
    score = F.when(F.col("text") == F.col("whole"), F.lit(EQUAL)).otherwise((F.col("s") + F.col("n") - F.col("hits")) / F.col("n"))
    fields = per.select("query", "text", score.alias("field_score")).join(rows, "text")
    return fields.groupBy("query", "item").agg(F.min("seq").alias("seq"), F.round(F.exp(F.sum(F.col("power") * F.log("field_score"))), DIGITS).alias("score"))


def best(found: DataFrame, n: int) -> DataFrame:
    """The first n items of each query, with their place from 1."""
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "seq", "item"))
    return found.withColumn("place", place).filter(F.col("place") <= n)


#: Fields and weights, thresholds, and how many hits are shown.
ARTIST_FIELDS = {"name_ja": 2.0, "name_zh": 2.0, "romaji": 1.5, "kana": 1.5, "aliases": 1.5}
VENUE_FIELDS = {"name_ja": 2.0, "name_zh": 2.0, "city": 1.0}
EVENT_FIELDS = {"title_ja": 2.0, "title_zh": 2.0, "tour_name": 1.0}
NEAR, NEAR_EVENT = 0.32, 0.30
ARTISTS, VENUES, EVENTS = 5, 4, 6


def search_all(queries: DataFrame, artists: DataFrame, venues: DataFrame, events: DataFrame) -> DataFrame:
    """query, kind (artist, venue, event), place, id: the best artists and venues, and events that match themselves followed by
    those of the best artist, each once.

    queries: query, pattern. artists, venues, events: id (string), seq (order), and their fields; events also artist_ids.
    """
    asked = queries.select("query", normal(F.col("pattern")).alias("_whole")).filter("_whole <> ''")
    patterns = asked.select(F.col("_whole").alias("query"), F.col("_whole").alias("pattern")).distinct()  # until the end a pattern is its own query
    top_artists = best(matches(patterns, field_rows(artists, ARTIST_FIELDS), NEAR), ARTISTS)
    top_venues = best(matches(patterns, field_rows(venues, VENUE_FIELDS), NEAR), VENUES)
    direct = best(matches(patterns, field_rows(events, EVENT_FIELDS), NEAR_EVENT), EVENTS).select("query", F.lit(0).alias("way"), "place", F.col("item").alias("id"))
    of_artist = events.select(F.explode(F.array_distinct("artist_ids")).alias("item"), "seq", "id")
    wanted = top_artists.filter("place = 1").select("query", "item")
    nearest = F.row_number().over(Window.partitionBy("item").orderBy("seq", "id"))
    # Of one artist's events no more than twice EVENTS can be shown: as many as are shown, behind as many that are there already.
    first = of_artist.join(wanted.select("item").distinct(), "item", "left_semi").withColumn("place", nearest).filter(F.col("place") <= 2 * EVENTS)
    via = wanted.join(first, "item").select("query", F.lit(1).alias("way"), "place", "id")
    each = direct.unionByName(via).groupBy("query", "id").agg(F.min(F.struct("way", "place")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("at", "id"))
    shown = each.withColumn("place", place).filter(F.col("place") <= EVENTS)
    row = lambda df, kind, key: df.select(F.col("query").alias("_whole"), F.lit(kind).alias("kind"), F.col("place").cast("int").alias("place"), F.col(key).cast("string").alias("id"))
    found = row(top_artists, "artist", "item").unionByName(row(top_venues, "venue", "item")).unionByName(row(shown, "event", "id"))
    return asked.join(found, "_whole").select("query", "kind", "place", "id")
