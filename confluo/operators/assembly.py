"""Published events from approved candidates, and reviews from events that are published.

Both are all or nothing: a candidate that does not meet the conditions, or an event whose identity is another than its
candidate's, is named and nothing is made. What is wrong is found in the same scan that makes the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions.status import event_type, phase_status, published_status

# Types of sources that an event may be traced to, and labels.
TRACEABLE = ("artist_official", "venue_official", "promoter_official", "ticket_official", "official_api", "ticket_api")
PRICE_LABEL, SALE_LABEL, PAGE_LABEL, TAG = "官方公布票价", "官方抽选／购票页面", "官方购票／演出页面", "官方来源"

TICKETS = "array<struct<name: string, price_jpy: bigint, tax_included: boolean, notes: array<string>>>"
FEES = "array<struct<type: string, label: string, amount_jpy: bigint>>"
RULES = "array<struct<label: string, applies_to: string>>"
PHASES = "array<struct<name: string, kind: string, start: string, end: string, url: string>>"
SOURCES = "array<struct<source_name: string, source_type: string, source_url: string, fetched_at: string>>"
EVIDENCE = "array<struct<source_url: string, source_type: string, fetched_at: string, verified_at: string, evidence_hash: string, confidence: double, availability_status: string, raw_content_hashes: array<string>>>"
#: A field's value is JSON, as fields are of different types.
FIELD = f"struct<availability_status: string, confidence: double, approval_state: string, approval_hash: string, verified_at: string, value: string, evidence: {EVIDENCE}>"
CANDIDATE = f"""id string, review_state string, ready_for_review boolean, required_fields_approved boolean, evidence_hash string, sources {SOURCES}, title string, artist_ids array<string>, artist_names array<string>, venue_id string, date string, open_time string, start_time string,
ticket_types {TICKETS}, prices_jpy array<bigint>, additional_fees {FEES}, eligibility {RULES}, ticket_urls array<string>, ticket_phases {PHASES}, status_hint string, fields map<string, {FIELD}>"""
#: Columns of a candidate, the fields they are approved as, and their types.
FIELDS = {
    "title": ("title", "string"), "artist_ids": ("artist", "array<string>"), "venue_id": ("venue", "string"), "date": ("eventDate", "string"), "open_time": ("openTime", "string"), "start_time": ("startTime", "string"), "ticket_types": ("ticketTypes", TICKETS), "prices_jpy": ("prices", "array<bigint>"),
    "additional_fees": ("additionalFees", FEES), "eligibility": ("eligibility", RULES), "ticket_urls": ("purchaseUrls", "array<string>"), "ticket_phases": ("ticketPhases", PHASES),
}
REQUIRED = ("title", "artist_ids", "venue_id", "date", "open_time", "start_time")
NOT_READY, UNTRACED, UNAPPROVED = "conditions not met", "no source to trace it to", "required fields not approved one by one"


def full(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def approved(column: str) -> Column:
    """A column's value as approved: what was found where there is no such field, null unless it was approved and published."""
    name, kind = FIELDS[column]
    f = F.try_element_at(F.col("fields"), F.lit(name))
    value = F.from_json(F.concat(F.lit('{"v":'), f["value"], F.lit("}")), f"v {kind}")["v"]
    return F.when(f.isNull(), F.col(column)).when((f["approval_state"] == "approved") & (f["availability_status"] == "published"), value)


def approval_hashes(fields: Column) -> Column:
    """The hash of the hashes of all approved fields, sorted."""
    known = F.filter(F.map_values(fields), lambda v: v["approval_state"] == "approved")
    return F.sha2(F.array_join(F.array_sort(F.transform(known, lambda v: F.coalesce(v["approval_hash"], F.lit("")))), "|"), 256)


def refusal(has_fields: Column) -> Column:
    """Why a candidate cannot be published, or null; to be asked after `approved` has replaced the columns."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    conditions = F.when(has_fields, yes("required_fields_approved")).otherwise(full(F.col("evidence_hash")) & full(F.col("_open")) & full(F.col("_start")))
    ready = (F.coalesce(F.col("review_state"), F.lit("")) == "approved") & yes("ready_for_review") & (F.coalesce(F.size("sources"), F.lit(0)) > 0) & conditions
    facts = F.lit(True)
    for c in REQUIRED:
        facts = facts & (F.coalesce(F.size(c), F.lit(0)) > 0 if c == "artist_ids" else full(F.col(c)))
    return F.when(~ready, NOT_READY).when(~F.exists("sources", lambda s: F.coalesce(s["source_type"].isin(*TRACEABLE), F.lit(False))), UNTRACED).when(~facts, UNAPPROVED)


def assembled(candidates: DataFrame, generated_at: str, today: str) -> DataFrame:
    """A row for each candidate (CANDIDATE): `refused` (why it cannot be published, or null) and the event's columns.

    Values are those approved. Ticket types become tiers, those without a name numbered; where there are none, prices do. Phases get
    their status by the day, links a label by whether a phase sells there.
    """
    none = lambda kind: F.array().cast(kind)
    has_fields = F.col("fields").isNotNull()
    rows = candidates.withColumns({"_open": F.col("open_time"), "_start": F.col("start_time"), "_kind": event_type(F.col("title"), F.col("artist_names"), F.coalesce(F.size("artist_ids"), F.lit(0)))})
    rows = rows.withColumns({c: approved(c) if c in REQUIRED else F.coalesce(approved(c), none(FIELDS[c][1])) for c in FIELDS})
    day = F.lit(today)
    phases = F.transform("ticket_phases", lambda p: F.struct(p["name"].alias("name"), p["kind"].alias("kind"), phase_status(p["start"], p["end"], day).alias("status"), p["start"].alias("start"), p["end"].alias("end"), p["url"].alias("url")))
    rows = rows.withColumns({"refused": refusal(has_fields), "phases": phases})
    number = lambda i: F.concat(F.lit(f"{PRICE_LABEL} "), (i + 1).cast("string"))
    note = lambda t: F.when(F.size(t["notes"]) > 0, F.nullif(F.array_join(t["notes"], " · "), F.lit("")))
    tier = lambda name, price, tax, n: F.struct(name.alias("name"), price.alias("price_jpy"), tax.alias("tax_included"), n.alias("note"))
    typed = F.transform("ticket_types", lambda t, i: tier(F.when(full(t["name"]), t["name"]).otherwise(number(i)), t["price_jpy"], t["tax_included"], note(t)))
    priced = F.transform("prices_jpy", lambda p, i: tier(F.when(F.size("prices_jpy") == 1, PRICE_LABEL).otherwise(number(i)), p, F.lit(None).cast("boolean"), F.lit(None).cast("string")))
    links = F.transform("ticket_urls", lambda u: F.struct(F.when(F.exists("phases", lambda p: p["url"] == u), SALE_LABEL).otherwise(PAGE_LABEL).alias("label"), u.alias("url"), F.lit("ticket").alias("purpose")))
    traced = F.filter("sources", lambda s: F.coalesce(s["source_type"].isin(*TRACEABLE), F.lit(False)))
    sources = F.transform(traced, lambda s: F.struct(s["source_name"].alias("name"), s["source_type"].alias("type"), s["source_url"].alias("url"), s["fetched_at"].alias("fetched_at")))
    proof = F.struct(F.lit("verified").alias("state"), F.lit(generated_at).alias("checked_at"), F.when(has_fields, approval_hashes(F.col("fields"))).otherwise(F.col("evidence_hash")).alias("evidence_hash"), sources.alias("sources"))
    provenance = F.transform_values("fields", lambda _, f: f.dropFields("value"))
    return rows.select(
        "id", "refused", "artist_ids", F.col("title").alias("title_ja"), F.col("title").alias("title_zh"), F.col("_kind").alias("type"), "venue_id", "date", "open_time", "start_time", F.when(F.col("date") < day, "completed").otherwise("scheduled").alias("event_status"),
        published_status(F.col("date"), F.col("status_hint"), F.transform("phases", lambda p: F.struct(p["kind"].alias("kind"), p["status"].alias("status"))), day).alias("status"), F.when(F.size("ticket_types") > 0, typed).otherwise(priced).alias("tiers"), "additional_fees", "phases", "eligibility", links.alias("ticket_links"),
        provenance.alias("field_provenance"), F.transform_values("fields", lambda _, f: f["availability_status"]).alias("availability"), proof.alias("verification"), F.array(F.lit(TAG)).alias("tags"),
    )


def refused(found: DataFrame, what: str, show: int = 5) -> None:
    """Raise if there are rows (id, reason)."""
    rows = found.orderBy("id").limit(show).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(f"{r.id}: {r.reason}" for r in rows))


def publish(candidates: DataFrame, generated_at: str, today: str) -> DataFrame:
    """The events of approved candidates; raises, naming the first of them, if any does not meet the conditions."""
    rows = assembled(candidates, generated_at, today)
    refused(rows.filter("refused is not null").select("id", F.col("refused").alias("reason")), "not published")
    return rows.drop("refused")


def event_offers(events: DataFrame) -> DataFrame:
    """The offers of assembled events, from their phases and links."""
    from confluo.operators.trips import offers_of_phases

    phases = events.select(F.col("id").alias("event_id"), F.explode("phases").alias("p")).select("event_id", "p.url", "p.kind", "p.status", "p.start", "p.end").filter("url is not null")
    return offers_of_phases(phases, events.select(F.col("id").alias("event_id"), F.explode("ticket_links.url").alias("url")))


#: Identity of an event: columns of the published one and of its candidate.
IDENTITY = {"title_ja": "title", "artist_ids": "artist_ids", "venue_id": "venue_id", "date": "date", "open_time": "open_time", "start_time": "start_time"}
NO_CANDIDATE, OTHER_IDENTITY = "no candidate with fields", "identity differs: "


def migration(published: DataFrame, candidates: DataFrame) -> DataFrame:
    """id, reason (why its review cannot be taken over, or null), fields (name to approval hash): a row for each published event.

    published: id and the columns of IDENTITY; candidates: id, ready_for_review, fields and theirs. Lists are compared sorted."""
    theirs = candidates.select("id", F.struct(*dict.fromkeys(IDENTITY.values()), "fields", F.coalesce("ready_for_review", F.lit(False)).alias("ready")).alias("c"))
    rows = published.join(theirs, "id", "left")

    def same(mine: str, other: str) -> Column:
        a, b = F.col(mine), F.col(f"c.{other}")
        if published.schema[mine].dataType.typeName() == "array":
            a, b = (F.array_sort(F.coalesce(x, F.array().cast("array<string>"))) for x in (a, b))
        return a.eqNullSafe(b)

    apart = F.array_compact(F.array(*[F.when(~same(a, b), a) for a, b in IDENTITY.items()]))
    reason = F.when(F.col("c").isNull() | ~F.col("c.ready") | F.col("c.fields").isNull(), NO_CANDIDATE).when(F.size(apart) > 0, F.concat(F.lit(OTHER_IDENTITY), F.array_join(apart, ",")))
    hashes = F.map_filter(F.transform_values("c.fields", lambda _, f: f["approval_hash"]), lambda _, h: full(h))
    return rows.select("id", reason.alias("reason"), hashes.alias("fields"))


def migrate_reviews(published: DataFrame, candidates: DataFrame, verified_at: str) -> DataFrame:
    """The reviews (id, verified_at, fields) of all published events; raises, naming the first, if one cannot be taken over."""
    rows = migration(published, candidates)
    refused(rows.filter("reason is not null").select("id", "reason"), "not migrated")
    return rows.select("id", F.lit(verified_at).alias("verified_at"), "fields")
