"""Fusing records of the same thing: grouping, election of the preferred record, merging of evidence field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions.status import availability_rank
from confluo.functions.text import normalize_name

#: Fields of which different values add up; of all others they are a conflict.
ADDITIVE = ("ticketTypes", "prices", "additionalFees", "ticketPhases", "eligibility", "purchaseUrls")
#: Fields that must be approved before publication.
REQUIRED = ("title", "artists", "venue", "date", "startTime", "officialUrl")


def fuse(records: DataFrame, key: list[str], priority: Column, seq: str, union: dict[str, str], primary: Column) -> DataFrame:
    """A row a key: members, the preferred record (highest priority, then first) as `preferred`, the distinct sorted
    values of the columns in `union`, and `evidence_level`."""
    rest = [c for c in records.columns if c not in key]
    lists = [F.array_sort(F.collect_set(c)).alias(name) for c, name in union.items()]
    out = records.groupBy(*key).agg(F.count("*").alias("members"), F.min_by(F.struct(*rest), F.struct((-priority).alias("p"), F.col(seq).alias("s"))).alias("preferred"), F.max(primary).alias("_primary"), *lists)
    level = F.when((F.col("members") >= 2) & F.col("_primary"), "corroborated").when(F.col("_primary"), "primary_official").otherwise("aggregator_only")
    return out.withColumn("evidence_level", level).drop("_primary")


def candidate_key(date: Column, venue_id: Column, venue_name: Column, artist_ids: Column, artist_name: Column, title: Column, time: Column, compatible: bool = True) -> Column:
    """What records of one thing share: date, venue (id, else normalised name), artists (sorted ids, else the normalised first
    name or title), time. `artist_name` is the first of the record's names."""
    some = lambda c: F.nullif(c, F.lit(""))
    name = lambda c: some(normalize_name(c, compatible))
    venue = F.coalesce(some(venue_id), name(venue_name), F.lit("unknown-venue"))
    artists = F.coalesce(some(F.array_join(F.array_sort(artist_ids), "+")), name(F.coalesce(some(artist_name), title)), name(title), F.lit(""))
    return F.concat_ws("|", F.coalesce(some(date), F.lit("unknown-date")), venue, artists, F.coalesce(some(time), F.lit("unknown-time")))


def stable_id(prefix: str, key: Column, n: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, n))


def evidence_hash(hashes: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(hashes), "|"), 256)


def merge_evidence(evidence: DataFrame, keys: list[str], field: str = "field") -> DataFrame:
    """Per key and field: value_json, availability_status, confidence, approval_hash, approval_state, n_values.

    evidence: keys, field, value_json (the canonical JSON of the value), items (of an additive field's array, the canonical
    JSON of each item), availability_status, evidence_hash, confidence. Several published values of an additive field
    make the union of their items, sorted by their JSON, prices as numbers; of another field they are a conflict without
    approval hash. Without a published value the status of highest rank prevails. As an approval covers every hash of
    its evidence, the hashes of one field of one thing are gathered, in one shuffle.
    """
    shown, status = F.col("availability_status") == "published", F.col("availability_status")
    rank = F.struct(availability_rank(status).alias("r"), status.alias("s"))
    out = evidence.groupBy(*keys, field).agg(
        F.collect_set(F.when(shown, F.col("value_json"))).alias("values"), F.collect_set(F.when(shown, F.col("items"))).alias("lists"), F.sort_array(F.collect_list(F.when(shown, F.col("evidence_hash")))).alias("hashes"), F.max(F.when(shown, F.col("confidence"))).alias("sure"),
        F.max(F.when(~shown, rank)).alias("worst"), F.collect_list(F.when(~shown, F.struct(status.alias("s"), F.col("evidence_hash").alias("h"), F.col("confidence").alias("c")))).alias("others"),
    )
    n, additive = F.size("values"), F.col(field).isin(*ADDITIVE)
    items = F.array_sort(F.array_distinct(F.flatten("lists")))
    numbers = F.transform(F.array_sort(F.transform(items, lambda x: F.struct(x.try_cast("double").alias("n"), x.alias("x")))), lambda s: s["x"])
    union = F.concat(F.lit("["), F.array_join(F.when(F.col(field) == "prices", numbers).otherwise(items), ","), F.lit("]"))
    conflict = (n > 1) & ~additive
    value = F.when(n == 1, F.element_at("values", 1)).when((n > 1) & additive, union)
    relevant = F.filter("others", lambda x: x["s"] == F.col("worst.s"))
    joined = F.array_join("hashes", "|")
    approval = F.when(conflict, None).when(n > 1, F.sha2(F.concat_ws("|", union, joined), 256)).when(n == 1, F.sha2(joined, 256)).otherwise(evidence_hash(F.transform(relevant, lambda x: x["h"])))
    return out.select(
        *keys, field, value.alias("value_json"), F.when(conflict, "conflicting_sources").when(n > 0, "published").otherwise(F.col("worst.s")).alias("availability_status"),
        F.when(n > 0, F.col("sure")).otherwise(F.array_max(F.transform(relevant, lambda x: x["c"]))).alias("confidence"), approval.alias("approval_hash"), F.when(conflict, "conflict").otherwise("pending_review").alias("approval_state"), n.alias("n_values"),
    )


def apply_approvals(merged: DataFrame, reviews: DataFrame, keys: list[str], field: str = "field") -> DataFrame:
    """merged with approval_state by the reviewed hash: conflict, pending_review, changed or approved. reviews: keys, field, approved_hash."""
    joined = merged.join(reviews, [*keys, field], "left")
    state = F.when(F.col("availability_status") == "conflicting_sources", "conflict").when(F.col("approved_hash").isNull(), "pending_review").when(~F.col("approved_hash").eqNullSafe(F.col("approval_hash")), "changed").otherwise("approved")
    return joined.withColumn("approval_state", state).drop("approved_hash")


def gate(approved: DataFrame, keys: list[str], required: tuple[str, ...] = REQUIRED, field: str = "field") -> DataFrame:
    """Per key: how many fields are approved, and whether all required ones are."""
    ok = F.col("approval_state") == "approved"
    out = approved.groupBy(*keys).agg(F.count_if(ok).alias("approved_fields"), F.size(F.collect_set(F.when(ok & F.col(field).isin(*required), F.col(field)))).alias("_n"))
    return out.withColumn("review_state", F.when(F.col("_n") == len(required), "approved").otherwise("candidate")).drop("_n")


def slot_conflicts(rows: DataFrame, slot: list[str], identity: Column) -> DataFrame:
    """Slots that hold more than one identity; a missing one counts as a value of its own."""
    return rows.groupBy(*slot).agg(F.count_distinct(F.coalesce(identity.cast("string"), F.lit("~"))).alias("identities"), F.count("*").alias("members")).filter("identities > 1")


def issues(**flags: Column) -> Column:
    """The names of the flags that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()]))
