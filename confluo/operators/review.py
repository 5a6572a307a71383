"""What stands against a candidate, and how decisions of reviewers are taken over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Issues that block a candidate, and fields that must be approved.
BLOCKING = ("missing_date", "missing_title", "unknown_artist", "partial_artist_resolution", "unknown_venue", "needs_primary_source", "venue_time_conflict", "artist_time_conflict")
FIELDS = ("title", "artist", "venue", "eventDate", "openTime", "startTime")


def decide(candidates: DataFrame) -> DataFrame:
    """Adds ready, state, reasons and primary_reason, and completes issues; no shuffle.

    candidates: issues array<string>, fields array<struct<name, availability, approval>>, evidence_hash, rejected boolean,
    approved boolean, approved_hash. An approval counts only for the evidence it was given for, and only where no issue
    blocks; else the candidate stays one and an issue says why. A candidate that is not approved has at least one reason.
    """
    blocking = F.filter("issues", lambda x: x.isin(*BLOCKING))
    fault = (
        F.when(F.col("approved_hash").isNull(), "approval_requires_evidence_hash").when(F.col("approved_hash") != F.col("evidence_hash"), "approval_stale").when(F.size(blocking) > 0, "approval_blocked")
    )
    considered = F.coalesce(F.col("approved"), F.lit(False)) & ~F.coalesce(F.col("rejected"), F.lit(False))
    out = candidates.withColumns({"ready": F.size(blocking) == 0, "_fault": F.when(considered, fault)})
    state = F.when(F.col("rejected"), "rejected").when(considered & F.col("_fault").isNull(), "approved").otherwise("candidate")
    out = out.withColumns({"state": state, "issues": added(F.col("issues"), F.col("_fault"))})
    open_fields = F.filter("fields", lambda x: x["name"].isin(*FIELDS) & ~x["approval"].eqNullSafe("approved"))
    named = F.transform(open_fields, lambda x: F.concat(F.lit("required_field:"), x["name"], F.lit(":"), x["availability"], F.lit(":"), x["approval"]))
    reasons = F.array_distinct(F.concat(F.filter("issues", lambda x: x.isin(*BLOCKING)), named))
    usual = F.when(F.col("state") == "rejected", "rejected").otherwise("field_review_pending")
    out = out.withColumn("reasons", reasons)
    out = out.withColumn("reasons", F.when((F.size("reasons") == 0) & (F.col("state") != "approved"), F.array(usual)).otherwise(F.col("reasons")))
    out = out.withColumn("primary_reason", F.try_element_at("reasons", F.lit(1)))
    return out.withColumn("issues", F.when(F.col("state") != "approved", added(F.col("issues"), F.col("primary_reason"))).otherwise(F.col("issues"))).drop("_fault")


def added(items: Column, one: Column) -> Column:
    """The items, with one more at the end unless it is null or among them."""
    return F.when(one.isNull() | F.array_contains(items, one), items).otherwise(F.array_append(items, one))


def take_over(ledger: DataFrame, batch: DataFrame, reviewer: str, at: Column) -> DataFrame:
    """The ledger with a batch of decisions: field by field the batch wins, other fields and events stay.

    ledger: event_id, fields map<string,string>, reviewer, verified_at. batch: event_id, fields. One row an event in both.
    """
    new = batch.select("event_id", F.col("fields").alias("_new"))
    both = ledger.join(new, "event_id", "full_outer")
    nothing = F.create_map().cast("map<string,string>")
    own = F.map_filter(F.coalesce("fields", nothing), lambda k, _: ~F.map_contains_key(F.coalesce("_new", nothing), k))
    fresh = F.col("_new").isNotNull()
    return both.select("event_id", F.map_concat(own, F.coalesce("_new", nothing)).alias("fields"), F.when(fresh, reviewer).otherwise(F.col("reviewer")).alias("reviewer"), F.when(fresh, at).otherwise(F.col("verified_at")).alias("verified_at"))


def decisions(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(approved: id, evidence_hash; rejected: id, reason) of an entity batch: id, decision, evidence_hash, reason."""
    return batch.filter("decision = 'approve'").select("id", "evidence_hash"), batch.filter("decision = 'reject'").select("id", "reason")


# Why a proposed venue is taken over or not, and what its id begins with.
PLACE_KNOWN, PLACE_UNKNOWN, VENUE_ID = "演出官方页确认场馆名，场馆官网确认所在地；未知资料保持 null", "缺少已核对的所在地或原始响应证据", "venue-ext-"


def venue_proposals(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """id, name_ja, prefecture, city, n_events, n_sources, raw_content_hashes, evidence_hash, decision, reason: a venue for each name
    that candidates give and no venue has.

    candidates: id, venue_name, issues, sources (source_id, source_event_id, content_hash); those with the issue `unknown_venue`
    count. facts: name, prefecture, city, source_url (places that were looked up; the first by source_url for a name). A proposal
    is approved if its place is known and a response shows its name; its hash covers what is known and all these responses.
    """
    from confluo.functions.text import normalize_name

    lost = candidates.filter(F.array_contains("issues", "unknown_venue") & F.col("venue_name").isNotNull())
    rows = lost.select(F.col("id").alias("event_id"), F.col("venue_name").alias("name_ja"), F.explode_outer("sources").alias("s"))
    hashes = F.array_sort(F.collect_set(F.when(F.col("s.content_hash") != "", F.col("s.content_hash"))))  # the evidence names each of them
    grouped = rows.groupBy("name_ja").agg(F.count_distinct("event_id").alias("n_events"), F.count_distinct(F.when(F.col("s").isNotNull(), F.struct("s.source_id", "s.source_event_id"))).alias("n_sources"), hashes.alias("raw_content_hashes"))
    places = facts.groupBy(F.col("name").alias("name_ja")).agg(F.min(F.struct("source_url", "prefecture", "city")).alias("f"))
    out = grouped.join(places, "name_ja", "left")
    said = F.struct(F.col("name_ja").alias("nameJa"), F.col("f.prefecture").alias("prefecture"), F.col("f.city").alias("city"), F.col("f.source_url").alias("officialVenueSourceUrl"), F.col("raw_content_hashes").alias("rawContentHashes"))
    fit = F.col("f").isNotNull() & (F.size("raw_content_hashes") > 0)
    return out.select(
        F.concat(F.lit(VENUE_ID), F.substring(F.sha2(normalize_name(F.col("name_ja")), 256), 1, 16)).alias("id"), "name_ja", "f.prefecture", "f.city", "n_events", "n_sources", "raw_content_hashes", F.sha2(F.to_json(said, {"ignoreNullFields": "false"}), 256).alias("evidence_hash"),
        F.when(fit, "approve").otherwise("reject").alias("decision"), F.when(fit, PLACE_KNOWN).otherwise(PLACE_UNKNOWN).alias("reason"),
    )
