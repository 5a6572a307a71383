"""Control of what is published: rules, guards, work queues, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.operators import ranking


def violations(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(path, rule): a row for each rule that a row breaks; all rules are tested in one pass."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return df.select(key.cast("string").alias("path"), F.explode(broken).alias("rule"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(key).cast("string").alias("path"), F.lit("duplicate id").alias("rule"))


def missing_references(df: DataFrame, key: str, ref: str, known: DataFrame, known_key: str, rule: str) -> DataFrame:
    out = df.filter(F.col(ref).isNotNull()).join(known.select(F.col(known_key).alias(ref)), ref, "left_anti")
    return out.select(F.col(key).cast("string").alias("path"), F.lit(rule).alias("rule"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def publish_blockers(before: DataFrame, after: DataFrame, offers_before: DataFrame, offers_after: DataFrame, retired: DataFrame, facts: list[str]) -> DataFrame:
    """(code, key): what speaks against publishing `after`.

    before, after: id, status. offers: key, id, url_kind, inventory, verified and the columns in `facts`. retired: key,
    checked (evidence that an offer has gone). Rules: the set of ids changed; a verified offer removed without evidence;
    a detail link replaced by a lesser one; sold out derived from one offer; an unverified offer with newly known facts.
    """
    ids = after.select("id").join(before, "id", "left_anti").unionByName(before.select("id").join(after, "id", "left_anti"))
    gone = offers_before.join(offers_after.select("key"), "key", "left_anti")
    without = gone.filter("verified").join(retired.select("key"), "key", "left_anti")
    lesser = offers_after.filter(F.col("url_kind").isin("search", "generic_provider")).select("id").distinct()
    downgraded = gone.filter("url_kind = 'event_detail'").join(lesser, "id", "left_semi")
    newly = after.filter("status = 'sold_out'").join(before.filter("status <> 'sold_out'").select("id"), "id", "left_semi")
    sold = offers_after.filter("inventory = 'sold_out'").groupBy("id").agg(F.count("*").alias("n"))
    single = newly.join(sold, "id", "left").filter(F.coalesce("n", F.lit(0)) <= 1)
    unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "unknown")
    old = offers_before.select("key", *[F.col(c).alias(f"old_{c}") for c in facts])
    filled = reduce(lambda a, b: a | b, [unknown(f"old_{c}") & ~unknown(c) for c in facts])
    became = offers_after.join(old, "key").filter(filled & ~F.col("verified"))
    row = lambda df, code, key: df.select(F.lit(code).alias("code"), F.col(key).cast("string").alias("key"))
    return union_all([row(ids, "event_ids_changed", "id"), row(without, "valid_offer_removed_without_evidence", "key"), row(downgraded, "detail_url_downgraded", "key"), row(single, "single_offer_promoted_to_event_sold_out", "id"), row(became, "unverified_fields_became_known", "key")])


def select_jobs(jobs: DataFrame, now: Column, urls: list[str], events: list[str], pending_limit: int, batch_limit: int) -> DataFrame:
    """Per chosen job: url, reasons, selected (within the batch). jobs: seq, url, event_id, status, next_check.

    Deferred jobs that are due, pending or deferred ones named by url or event, then pending ones up to `pending_limit`
    in all, by seq. Only the first few pending ones can count, so they are taken by a top-k, not by sorting all.
    """
    if not 0 <= pending_limit <= 10 or batch_limit < 1:
        raise ValueError("pending_limit is 0 to 10, batch_limit at least 1")
    open_job = F.col("status").isin("pending", "deferred")
    due = (F.col("status") == "deferred") & (F.col("next_check") <= now)
    reasons = F.array_compact(F.array(F.when(due, "due"), F.when(open_job & F.col("url").isin(*urls), "url"), F.when(open_job & F.col("event_id").isin(*events), "event")))
    marked = jobs.withColumn("reasons", reasons)
    chosen = marked.filter(F.size("reasons") > 0)
    if pending_limit:
        already = chosen.filter("status = 'pending'").agg(F.least(F.count("*"), F.lit(pending_limit)).alias("have"))
        more = ranking.ranks_of_top(marked.filter((F.col("status") == "pending") & (F.size("reasons") == 0)), [F.col("seq")], pending_limit, "nth")
        more = more.crossJoin(already).filter(F.col("nth") <= pending_limit - F.col("have")).drop("nth", "have").withColumn("reasons", F.array(F.lit("pending limit")))
        chosen = chosen.unionByName(more)
    out = chosen.select("seq", "url", "status", F.array_join("reasons", ",").alias("reasons"))
    return ranking.batch(out, [F.col("seq")], batch_limit)


def merge_queue(seed: DataFrame, previous: DataFrame) -> DataFrame:
    """The seed's jobs with the state that earlier ones of the same url had; others of old vanish. url, role; url, status, attempts."""
    joined = seed.join(previous.select("url", F.col("status").alias("_s"), F.col("attempts").alias("_n")), "url", "left")
    return joined.withColumn("status", F.coalesce("_s", F.lit("pending"))).withColumn("attempts", F.coalesce("_n", F.lit(0))).drop("_s", "_n")


def planned_ids(spark, ids: list[str], known: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The distinct ids asked for, by name; refused if there are none, too many, or unknown ones."""
    wanted = sorted(set(ids))
    if not 0 < len(wanted) <= most:
        raise ValueError(f"1 to {most} ids are needed")
    df = spark.createDataFrame([(x,) for x in wanted], f"{key} string")
    lost = [r[0] for r in df.join(known.select(key), key, "left_anti").collect()]
    if lost:
        raise ValueError(f"unknown ids: {', '.join(lost)}")
    return df


def seed_jobs(links: DataFrame) -> DataFrame:
    """A job for each canonical url of unchecked links, with the events that name it. links: event_id, url, role, checked."""
    from confluo.functions.urls import canonical

    rows = links.filter(~F.coalesce("checked", F.lit(False))).withColumn("url", canonical(F.col("url"))).filter("url is not null")
    return rows.groupBy("url").agg(F.min_by("role", F.when(F.col("role") == "ticket_detail", 0).otherwise(1)).alias("role"), F.array_sort(F.collect_set("event_id")).alias("event_ids"), F.lit("pending").alias("status"))


def without_facts(offers: DataFrame, facts: list[str], kind: str = "url_kind") -> DataFrame:
    """Offers whose link is no page of one event lose all facts."""
    return offers.withColumns({c: F.when(F.col(kind) == "event_detail", F.col(c)) for c in facts})


def gated(df: DataFrame, broken: DataFrame) -> DataFrame:
    """df, if no rule is broken."""
    found = [r["rule"] for r in broken.select("rule").distinct().orderBy("rule").limit(5).collect()]
    if found:
        raise ValueError(f"not published, as rules are broken: {', '.join(found)}")
    return df
