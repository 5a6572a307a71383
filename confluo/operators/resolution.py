"""Entity resolution: exact variants, folded variants, containment, scored matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.functions import text


def exact(records: DataFrame, name: str, variants: DataFrame) -> DataFrame:
    """Each record with each entity of which `name` is a variant. variants: entity_id, variant."""
    return records.join(variants, records[name] == variants["variant"]).drop("variant")


def unresolved(records: DataFrame, name: str, variants: DataFrame) -> DataFrame:
    return records.join(variants, records[name] == variants["variant"], "left_anti")


def folded(records: DataFrame, name: str, variants: DataFrame, compatible: bool = True) -> DataFrame:
    """Of records without an exact variant, those that meet one once kana are folded: for review."""
    left = unresolved(records, name, variants).withColumn("_folded", text.fold_japanese(F.col(name), compatible))
    return left.join(variants.select("entity_id", text.fold_japanese(F.col("variant"), compatible).alias("_folded")), "_folded").drop("_folded").distinct()


def contained(records: DataFrame, key: str, name: str, variants: DataFrame, least: int = 5) -> DataFrame:
    """The entity whose variant of at least `least` characters holds the name or is held by it; the longest variant wins,
    then the smallest id. A variant within a name shares all its pieces of `least` characters with it, so it meets names by
    the one that is rarest among names; a name within a variant by the one that is rarest among variants. Names that are
    shorter than a piece meet variants by themselves."""
    own = variants.filter(F.char_length("variant") >= least)
    longest = own.groupBy("entity_id").agg(F.max(F.char_length("variant")).alias("longest"))

    def pieces(c, n):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))

    def rarest(texts: DataFrame, c: str, among: DataFrame) -> DataFrame:
        """Each text with its piece that is rarest among others'; texts with a piece that no other has are left out."""
        counts = among.groupBy("piece").agg(F.count("*").alias("n"))
        met = texts.withColumn("piece", F.explode(pieces(F.col(c), least))).join(counts, "piece", "left")
        return met.groupBy(c).agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("piece"), F.min(F.coalesce("n", F.lit(0))).alias("n")).filter("n > 0").drop("n")

    names, texts = records.select(key, name).distinct(), own.select("variant").distinct()
    long_names, short_names = names.select(name).distinct().filter(F.char_length(name) >= least), names.select(name).distinct().filter(F.char_length(name).between(1, least - 1))
    name_pieces, text_pieces = long_names.withColumn("piece", F.explode(pieces(F.col(name), least))), texts.withColumn("piece", F.explode(pieces(F.col("variant"), least)))
    met = name_pieces.join(rarest(texts, "variant", name_pieces), "piece").select(name, "variant").filter(F.contains(F.col(name), F.col("variant")))
    met = met.unionByName(text_pieces.join(rarest(long_names, name, text_pieces), "piece").select(name, "variant").filter(F.contains(F.col("variant"), F.col(name))))
    for n in range(1, least):
        part = short_names.filter(F.char_length(name) == n).withColumn("piece", F.col(name))
        met = met.unionByName(part.join(texts.withColumn("piece", F.explode(pieces(F.col("variant"), n))), "piece").select(name, "variant"))
    found = met.distinct().join(own, "variant").join(longest, "entity_id").groupBy(name).agg(F.min_by("entity_id", F.struct(-F.col("longest"), F.col("entity_id"))).alias("contained_id"))
    return names.join(found, name).select(key, "contained_id")


def held(records: DataFrame, name: str, variants: DataFrame, most: int = 100_000) -> DataFrame:
    """Each record with each variant (entity_id, variant) that its name holds, however long either is.

    A variant of three words or more holds whole words of the name between its first and last space, so it meets the names
    with the longest of these; variants of one or two words have none and are compared with all names. Variants are
    broadcast only while they are at most `most`.
    """
    words = F.split("variant", " ")
    inner = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w")))
    anchored = variants.withColumn("_anchor", F.array_max(inner)["w"])
    anchored = F.broadcast(anchored) if variants.count() <= most else anchored
    inside = F.contains(F.col(name), F.col("variant"))
    by_word = records.withColumn("_anchor", F.explode(F.array_distinct(F.split(name, " ")))).join(anchored, "_anchor").filter(inside)
    return by_word.drop("_anchor").unionByName(records.join(anchored.filter("_anchor is null").drop("_anchor"), inside))


def resolve(records: DataFrame, key: str, name: str, hint: str, variants: DataFrame, aliases: DataFrame) -> DataFrame:
    """records with entity_id by the first that gives one: a known hint, an alias (name, alias_id), an exact variant, containment."""
    ids = variants.select(F.col("entity_id").alias("_hint")).distinct()
    first = variants.groupBy(F.col("variant").alias(name)).agg(F.min("entity_id").alias("_exact"))
    out = records.join(ids, records[hint] == ids["_hint"], "left").join(aliases.select(F.col("name").alias(name), F.col("alias_id")), name, "left").join(first, name, "left")
    known = variants.select(F.col("entity_id").alias("_alias")).distinct()
    out = out.join(known, F.col("alias_id") == F.col("_alias"), "left")
    out = out.withColumn("_id", F.coalesce("_hint", "_alias", "_exact"))
    rest = contained(out.filter("_id is null"), key, name, variants)
    return out.join(rest, key, "left").withColumn("entity_id", F.coalesce("_id", "contained_id")).drop("_hint", "_alias", "_exact", "_id", "alias_id", "contained_id")


def match_score(same_date, venue, same_time, artist, title):
    """Fixed weights of agreeing date, venue, time, artist and title, added in that order (venue and time alone stay below 0.45)."""
    return (F.when(same_date, 0.35).otherwise(0.0) + F.when(venue >= 0.75, 0.3).otherwise(0.0) + F.when(same_time, 0.15).otherwise(0.0) + F.when(artist >= 0.75, 0.15).otherwise(0.0) + F.when(title >= 0.6, 0.05).otherwise(0.0))


def similar_names(one: DataFrame, two: DataFrame, threshold: float) -> DataFrame:
    """name, other: of two tables of distinct names (name; other), not empty, those with an overlap of `threshold` or more, equal
    ones included. Of two such names one has a character among its rarest ones (all but `threshold` of them, and one) that the
    other has too, so names meet by those."""
    letters = lambda df, name: df.select(name, F.explode(F.array_distinct(F.split(name, ""))).alias("_c"))
    counts = letters(one, "name").select("_c").unionByName(letters(two, "other").select("_c")).groupBy("_c").agg(F.count("*").alias("_n"))

    def rare(df: DataFrame, name: str) -> DataFrame:
        own = letters(df, name).join(counts, "_c").groupBy(name).agg(F.sort_array(F.collect_list(F.struct("_n", "_c"))).alias("_l"))
        n = F.size("_l") - F.ceil(F.size("_l") * threshold).cast("int") + 1
        return own.select(name, F.explode(F.slice("_l", F.lit(1), n)).alias("_x")).select(name, "_x._c")

    met = rare(one, "name").join(letters(two, "other"), "_c").unionByName(letters(one, "name").join(rare(two, "other"), "_c"))
    met = met.select("name", "other").distinct()
    return met.filter(text.overlap_score(F.col("name"), F.col("other")) >= threshold)


#: The facts that an observation and an event may agree in, their weights in the order they add up, and how alike names must be.
FACTS = (("date", 0.35), ("venue_name", 0.3), ("start_time", 0.15), ("artist_names", 0.15), ("title", 0.05))
ALIKE = {"venue_name": 0.75, "artist_names": 0.75, "title": 0.6}
DATE_VENUE, DATE_VENUE_TIME = 0b00011, 0b00111


def worth(mask: int) -> float:
    total = 0.0
    for i, (_, weight) in enumerate(FACTS):
        total += weight if mask >> i & 1 else 0.0
    return total


#: The facts whose values are alike rather than equal, by place, and the others.
LIKE, EQUAL = {1: "venue_name", 3: "artist_names", 4: "title"}, {0: "date", 2: "start_time"}


def values_of(df: DataFrame, name: str) -> Column:
    """The values of a fact that are there, as a list."""
    c = F.array_distinct(F.coalesce(F.col(name), F.array().cast("array<string>"))) if name == "artist_names" else F.array(name)
    return F.filter(c, lambda v: v.isNotNull() & (v != ""))


def with_equal_facts(rows: DataFrame) -> DataFrame:
    """mask, key and the other columns: a row for each set of the equal facts with the alike ones of the row. rows: like (its mask),
    parts (its values, a list), date, start_time."""
    out = []
    for chosen in range(1 << len(EQUAL)):
        names = [(i, name) for n, (i, name) in enumerate(EQUAL.items()) if chosen >> n & 1]
        mask = F.col("like") + sum(1 << i for i, _ in names)
        there = F.lit(True)
        for _, name in names:
            there = there & (F.coalesce(F.col(name), F.lit("")) != "")
        out.append(F.when(there & (mask > 0), F.struct(mask.cast("int").alias("mask"), F.array_join(F.concat(F.array(mask.cast("string")), F.array(*[F.col(n) for _, n in names]).cast("array<string>"), F.col("parts")), "\x01").alias("key"))))
    found = rows.withColumn("_k", F.array_compact(F.array(*out)))
    return found.withColumn("_k", F.explode("_k")).select(*[c for c in rows.columns if c not in ("like", "parts", "date", "start_time")], "_k.*")


def like_combinations(observations: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets of alike facts with their values, of events and of observations, as rows of obs_id or id, like, parts, date, start_time.

    An observation gets those combinations of names alike to its own that some event has: names of one fact are looked up
    among the distinct combinations, and the others' held against what is alike, so no product of lists is made."""
    e = events.select("id", "date", "start_time", *[F.explode_outer(values_of(events, n)).alias(n) if n == "artist_names" else F.get(values_of(events, n), F.lit(0)).alias(n) for n in LIKE.values()])
    own = observations.select("obs_id", "date", "start_time")
    for name, threshold in ALIKE.items():
        asked = observations.select("obs_id", F.explode(values_of(observations, name)).alias("name"))
        pairs = asked.join(similar_names(asked.select("name").distinct(), e.select(F.col(name).alias("other")).filter("other is not null").distinct(), threshold), "name")
        own = own.join(pairs.groupBy("obs_id").agg(F.collect_set("other").alias(f"_{name}")), "obs_id", "left")
    of_events, of_observations = [], []
    for like in range(1 << len(LIKE)):
        names = [n for i, n in enumerate(LIKE.values()) if like >> i & 1]
        mask = sum(1 << i for i, n in LIKE.items() if n in names)
        there = F.lit(True)
        for n in names:
            there = there & F.col(n).isNotNull()
        parts = F.array(*[F.col(n) for n in names]).cast("array<string>")
        of_events.append(e.filter(there).select("id", F.lit(mask).alias("like"), parts.alias("parts"), "date", "start_time").distinct())
        rows = own
        if names:
            first = max(names, key=lambda n: ("venue_name", "title", "artist_names").index(n))  # the one that fewest combinations share, most likely
            rows = own.withColumn("_one", F.explode(f"_{first}")).join(e.filter(there).select(*names).distinct(), F.col("_one") == F.col(first))
            for n in names:
                rows = rows if n == first else rows.filter(F.array_contains(f"_{n}", F.col(n)))
        of_observations.append(rows.select("obs_id", F.lit(mask).alias("like"), parts.alias("parts"), "date", "start_time"))
    union = lambda frames: reduce(lambda x, y: x.unionByName(y), frames)
    return union(of_events), union(of_observations)


def match_observations(observations: DataFrame, events: DataFrame) -> DataFrame:
    """Per observation: event_id, level, reason, score.

    observations: obs_id, date, venue_name, start_time, title, artist_names and, if a source chain hints at an event, hint_id;
    events: the same with id. All names normalised. A hinted event of a score of 0.65 or more is confirmed, unless others
    share its date and venue and its time differs. Else one event of the same date and venue is confirmed; of several, one
    with the same time. Else the best score of 0.45 or more is probable, of equal ones the event with the smallest id. Others
    are unmatched; their score is the best of all events.

    Observations and events never meet in pairs. Events are counted by each set of facts they may agree in (31 of five), with
    the smallest id of each group; an observation looks up the groups of its own facts, with names that are alike to its
    own, as far as events have them together. The best set that has a group is the best score, and its smallest id the event, as an event that agreed in more
    would be in a better group. So a date or venue with many events is one row for each set of facts.
    """
    theirs, mine = like_combinations(observations, events)
    groups = with_equal_facts(theirs).groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    asks = with_equal_facts(mine)
    score = F.element_at(F.array(*[F.lit(worth(m)) for m in range(1, 1 << len(FACTS))]), F.col("mask"))
    hits = asks.join(groups, "key").withColumn("score", score)
    has = lambda mask: F.col("mask").bitwiseAND(mask) == mask
    found = hits.groupBy("obs_id").agg(
        F.coalesce(F.sum(F.when(F.col("mask") == DATE_VENUE, F.col("n"))), F.lit(0)).alias("n_same"), F.coalesce(F.sum(F.when(F.col("mask") == DATE_VENUE_TIME, F.col("n"))), F.lit(0)).alias("n_timed"),
        F.struct(F.min(F.when(F.col("mask") == DATE_VENUE, F.col("id"))).alias("event_id"), F.max(F.when(has(DATE_VENUE), F.col("score"))).alias("score")).alias("one"),
        F.struct(F.min(F.when(F.col("mask") == DATE_VENUE_TIME, F.col("id"))).alias("event_id"), F.max(F.when(has(DATE_VENUE_TIME), F.col("score"))).alias("score")).alias("exact"),
        F.min_by(F.struct(F.col("id").alias("event_id"), "score"), F.struct(-F.col("score"), F.col("id"))).alias("best"),
    )

    best_artist = F.coalesce(F.array_max(F.flatten(F.transform("o.artist_names", lambda x: F.transform(F.col("e.artist_names"), lambda y: text.overlap_score(x, y))))), F.lit(0.0))
    same_time = F.coalesce((F.col("o.start_time") == F.col("e.start_time")) & (F.col("o.start_time") != ""), F.lit(False))

    def scored(joined: DataFrame) -> DataFrame:
        venue = text.overlap_score(F.col("o.venue_name"), F.col("e.venue_name"))
        of_pair = match_score(F.coalesce((F.col("o.date") == F.col("e.date")) & (F.col("o.date") != ""), F.lit(False)), venue, same_time, best_artist, text.overlap_score(F.col("o.title"), F.col("e.title")))
        return joined.select("o.obs_id", F.col("e.id").alias("event_id"), of_pair.alias("score"))

    confirmed = lambda x, reason: F.struct(F.col(f"{x}.event_id").alias("event_id"), F.lit("confirmed").alias("level"), F.lit(reason).alias("reason"), F.col(f"{x}.score").alias("score"))
    result = (
        F.when(F.col("hint").isNotNull(), confirmed("hint", "source_chain_match")).when(F.col("n_same") == 1, confirmed("one", "date_venue")).when((F.col("n_same") > 1) & (F.col("n_timed") == 1), confirmed("exact", "date_venue_time"))
        .when(F.col("best.score") >= 0.45, F.struct("best.event_id", F.lit("probable").alias("level"), F.when(F.col("n_same") > 1, "ambiguous_same_day_venue").otherwise("light_score").alias("reason"), "best.score"))
        .otherwise(F.struct(F.lit(None).cast(events.schema["id"].dataType).alias("event_id"), F.lit("unmatched").alias("level"), F.lit("insufficient_evidence").alias("reason"), F.coalesce("best.score", F.lit(0.0)).alias("score")))
    )
    if "hint_id" in observations.columns:
        hints = hinted_events(observations, events, scored, same_time)
    else:
        hints = found.select("obs_id", F.col("best").alias("hint")).filter(F.lit(False))
    out = observations.select("obs_id").join(found, "obs_id", "left").join(hints, "obs_id", "left")
    return out.select("obs_id", result.alias("r")).select("obs_id", "r.*")


def hinted_events(observations: DataFrame, events: DataFrame, scored, same_time) -> DataFrame:
    """obs_id, hint (event_id, score) of hinted events that are confirmed. Events are counted by date and venue before hinted ones
    meet those of their date."""
    places = events.filter("date <> '' and venue_name <> ''").groupBy(F.col("date").alias("p_date"), F.col("venue_name").alias("p_venue")).agg(F.count("*").alias("n"))
    hinted = events.join(observations.select(F.col("hint_id").alias("id")).distinct(), "id", "left_semi")
    alike = hinted.join(places, F.col("date") == F.col("p_date")).filter(text.overlap_score(F.col("p_venue"), F.col("venue_name")) >= 0.75)
    crowds = alike.groupBy(F.col("id").alias("crowd_id")).agg(F.sum("n").alias("crowd"))
    e = hinted.join(crowds, F.col("id") == F.col("crowd_id"), "left").alias("e")
    joined = observations.alias("o").join(e, F.col("o.hint_id") == F.col("e.id"))
    clear = ~(F.coalesce(F.col("e.crowd") > 1, F.lit(False)) & (F.coalesce(F.col("e.start_time"), F.lit("")) != "")) | same_time
    return scored(joined.filter(clear)).filter("score >= 0.65").select("obs_id", F.struct("event_id", "score").alias("hint"))


def fuzzy_top(queries: DataFrame, items: DataFrame, key: str, name: str, threshold: float, n: int, block: int = 10_000) -> DataFrame:
    """Per query the n best items by edit distance over length, at or below the threshold, ties by id. queries: query.

    The queries, a stated set, are compared with all items in blocks of about `block`, each sent to every task, so any
    number of them works and none holds more than a block.
    """
    blocks = max(1, -(-queries.count() // block))
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    longest = F.greatest(F.char_length("query"), F.char_length(name))
    near = F.abs(F.char_length("query") - F.char_length(name)) <= threshold * longest  # else the distance is larger
    pairs = None
    for i in range(blocks):
        part = F.broadcast(dealt.filter(F.col("_block") == i).drop("_block")).crossJoin(items).filter(near)
        pairs = part if pairs is None else pairs.unionByName(part)
    scored = pairs.withColumn("distance", F.round(F.levenshtein(F.col("query"), F.col(name)) / longest, 6)).filter(F.col("distance") <= threshold)
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    return scored.withColumn("place", place).filter(F.col("place") <= n)
