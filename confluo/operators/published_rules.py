"""The rules of what is published: artists, venues, events with all they hold, and candidates. Columns as in the schemas here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import Each, Reference, Rule, Table, Unique, bad_date, bad_instant, bad_time, bad_url, blank, empty, none_of, outside, true

# What fields may hold.
STATUSES = ("announced", "lottery", "on_sale", "sold_out", "resale", "ended")
LIFECYCLE = ("scheduled", "postponed", "cancelled", "rescheduled", "completed")
SALE_STATUSES, INVENTORY = ("announced", "not_started", "open", "closed", "unknown"), ("available", "low", "sold_out", "unknown")
PROVIDERS = ("eplus", "pia", "lawson", "ticketbook", "other")
URL_KINDS = ("event_detail", "generic_provider", "search", "support", "refund", "unknown")
SALE_TYPES = ("fan_club_lottery", "playguide_lottery", "general_sale", "official_resale", "other")
EVENT_TYPES = ("oneman", "taiban", "fes", "idol_seiyu", "release_event")
TIERS, MODELS = ("livehouse", "hall", "arena", "dome", "stadium"), ("tokyo-dome", "budokan", "yokohama-arena")
PHASE_STATUSES, PHASE_KINDS = ("upcoming", "open", "closed"), ("fc_lottery", "playguide_lottery", "general", "resale")
AVAILABILITY = ("not_checked", "not_found_on_page", "published", "not_announced", "source_does_not_disclose", "parser_failed", "page_fetch_failed", "blocked", "pending_review", "conflicting_sources")
#: States in which a field that need not be published may wait for approval, and states of that wait.
WAITING = ("not_checked", "not_found_on_page", "parser_failed", "page_fetch_failed", "blocked", "pending_review", "conflicting_sources")
WAITS = ("pending_review", "changed", "conflict")
FIELDS = ("title", "artist", "venue", "eventDate", "openTime", "startTime", "ticketTypes", "prices", "additionalFees", "ticketPhases", "eligibility", "purchaseUrls")
REQUIRED = FIELDS[:6]
SOURCE_TYPES = ("artist_official", "venue_official", "promoter_official", "ticket_official", "official_api", "ticket_api")
SOURCE_ROLES = ("venue_schedule", "venue_detail", "artist_official", "promoter_official", "ticket_detail", "structured_api")
UNREAD = ("not_checked", "page_fetch_failed", "parser_failed")
LINK_PURPOSES, MATCH_LEVELS = ("ticket", "official_info"), ("confirmed", "probable")

SOURCES = "array<struct<name: string, url: string, type: string>>"
VERIFICATION = f"struct<state: string, evidence_hash: string, checked_at: string, sources: {SOURCES}>"
EVIDENCE = "array<struct<source_url: string, source_type: string, fetched_at: string, verified_at: string, evidence_hash: string, confidence: double, availability_status: string, raw_content_hashes: array<string>>>"
ARTIST = f"id string, name_ja string, name_zh string, romaji string, kana string, profile_status string, genres array<string>, popularity double, verification {VERIFICATION}"
VENUE = f"id string, name_ja string, name_zh string, prefecture string, city string, lat double, lng double, capacity double, tier string, model3d string, profile_status string, verification {VERIFICATION}"
TICKET = "array<struct<id: string, event_id: string, provider: string, url_kind: string, sale_type: string, sale_status: string, inventory_status: string, url: string, source_url: string, last_verified_at: string, start_at: string, end_at: string, result_at: string, payment_deadline: string, ticket_display_at: string, eligibility: array<string>, membership_requirement: string, region_restriction: string, phone_verification: string, companion_restriction: string, ticket_distribution: string, match_level: string>>"
APPROVED = "struct<review_state: string, fields: map<string, struct<value: string, ids: array<string>, approval_state: string, availability_status: string, approval_hash: string>>>"
EVENT = f"""id string, title_ja string, title_zh string, artist_ids array<string>, venue_id string, date string, open_time string, start_time string, type string, status string, event_status string, tiers array<struct<name: string, price_jpy: double>>,
additional_fees array<struct<label: string, amount_jpy: double>>, phases array<struct<name: string, kind: string, status: string, start: string, end: string, url: string>>, ticket_links array<struct<label: string, url: string, purpose: string>>, ticket_offers {TICKET}, eligibility array<string>,
availability map<string, string>, field_provenance map<string, struct<availability_status: string, approval_state: string, approval_hash: string, verified_at: string, evidence: {EVIDENCE}>>, verification {VERIFICATION}, approved {APPROVED}"""
CANDIDATE = f"id string, review_state string, issues array<string>, source_chain array<struct<role: string, source_id: string, url: string, fetch_status: string, content_hash: string, http_status: int>>, fields map<string, struct<availability_status: string, evidence: {EVIDENCE}>>"


def missing(path: str, column: str | None = None) -> Rule:
    return Rule(f".{path}", "missing", lambda x: blank(x(column or path)))


def unknown(path: str, values: tuple[str, ...]) -> Rule:
    return Rule(f".{path}", "unknown value", lambda x: none_of(x(path), values))


def whole(c: Column, least: int = 0) -> Column:
    """Broken: null, not a whole number, or less than `least`."""
    return outside(c, least) | true(c.cast("double") != F.floor(c))


def unproven(v: Column) -> Column:
    return ~true(v["state"] == "verified") | blank(v["checked_at"]) | blank(v["evidence_hash"])


def profile(path: str, minimal: Column, broken: Column) -> Column:
    return F.when(minimal, F.lit(False)).otherwise(broken)


_MINIMAL = lambda x: true(x("profile_status") == "minimal")
_PROFILE = Rule(".verification", "minimal profile without proof", lambda x: _MINIMAL(x) & (unproven(x("verification")) | empty(x("verification")["sources"])))


def must_be_null(*names: str) -> list[Rule]:
    """What a minimal profile does not know must be null."""
    return [Rule(f".{n}", "known in a minimal profile", lambda x, n=n: _MINIMAL(x) & x(n).isNotNull()) for n in names]


def full(path: str, rule: str, broken) -> Rule:
    """Holds for whole profiles alone."""
    return Rule(f".{path}", rule, lambda x: ~_MINIMAL(x) & broken(x))


ARTISTS = Table(
    "artists", "id",
    (
        missing("id"), missing("name_ja"), *must_be_null("name_zh", "romaji", "kana"), _PROFILE, *[full(n, "missing", lambda x, n=n: blank(x(n))) for n in ("name_zh", "romaji")],
        full("kana", "null", lambda x: x("kana").isNull()), Rule(".genres", "no list", lambda x: x("genres").isNull()), Rule(".popularity", "negative", lambda x: x("popularity").isNotNull() & outside(x("popularity"), 0)),
    ),
    unique=(Unique("id", lambda x: F.array(x("id")), "duplicate id"),),
)

VENUES = Table(
    "venues", "id",
    (
        missing("id"), missing("name_ja"), missing("prefecture"), *must_be_null("name_zh", "lat", "lng", "capacity", "tier"), Rule(".city", "empty", lambda x: _MINIMAL(x) & x("city").isNotNull() & blank(x("city"))), _PROFILE,
        *[full(n, "missing", lambda x, n=n: blank(x(n))) for n in ("name_zh", "city")], full("lat", "out of range", lambda x: outside(x("lat"), -90, 90)), full("lng", "out of range", lambda x: outside(x("lng"), -180, 180)),
        full("capacity", "no positive number", lambda x: whole(x("capacity"), 1)), full("tier", "unknown value", lambda x: none_of(x("tier"), TIERS)), Rule(".model3d", "unknown value", lambda x: ~blank(x("model3d")) & none_of(x("model3d"), MODELS)),
    ),
    unique=(Unique("id", lambda x: F.array(x("id")), "duplicate id"),),
)


def phase_span(x) -> Column:
    return ~(bad_date(x("start")) | bad_date(x("end"))) & true(x("start") > x("end"))


def offer_rules() -> list[Rule]:
    dates = [Rule(f".{n}", "no time", lambda x, n=n: x(n).isNotNull() & bad_instant(x(n))) for n in ("start_at", "end_at", "result_at", "payment_deadline", "ticket_display_at")]
    texts = [Rule(f".{n}", "empty", lambda x, n=n: x(n).isNotNull() & blank(x(n))) for n in ("membership_requirement", "region_restriction", "phone_verification", "companion_restriction", "ticket_distribution")]
    sets = [unknown("provider", PROVIDERS), unknown("url_kind", URL_KINDS), unknown("sale_type", SALE_TYPES), unknown("sale_status", SALE_STATUSES), unknown("inventory_status", INVENTORY), unknown("match_level", MATCH_LEVELS)]
    return [missing("id"), *sets, Rule(".url", "no web address", lambda x: bad_url(x("url")) | bad_url(x("source_url"))), Rule(".last_verified_at", "no time", lambda x: bad_instant(x("last_verified_at"))), *dates, Rule(".eligibility", "no list", lambda x: x("eligibility").isNull()), *texts]


def may_wait(x) -> Column:
    return ~x("field").isin(*REQUIRED) & true(x("availability").isin(*WAITING))


def evidence_rules() -> list[Rule]:
    whole_ = lambda x: bad_url(x("e")["source_url"]) | none_of(x("e")["source_type"], SOURCE_TYPES) | blank(x("e")["fetched_at"]) | (~x("waits") & blank(x("e")["verified_at"])) | blank(x("e")["evidence_hash"]) | outside(x("e")["confidence"], 0, 1) | none_of(x("e")["availability_status"], AVAILABILITY)
    hashes = lambda x: empty(x("e")["raw_content_hashes"]) | F.exists(F.coalesce(x("e")["raw_content_hashes"], F.array()), lambda h: ~true(h.rlike(r"^[a-f0-9]{64}\z")))
    return [Rule("", "incomplete evidence", whole_), Rule(".raw_content_hashes", "no raw evidence", hashes)]


def provenance(x) -> Column:
    """A row for each field: field, availability, p (its provenance)."""
    return F.when(x("availability").isNotNull() & x("field_provenance").isNotNull(), F.transform(F.array(*map(F.lit, FIELDS)), lambda f: F.struct(f.alias("field"), x("availability")[f].alias("availability"), x("field_provenance")[f].alias("p"))))


def unapproved(x) -> Column:
    p, waits = x("p"), may_wait(x)
    done = true(p["approval_state"] == "approved") & ~blank(p["approval_hash"]) & ~blank(p["verified_at"])
    return F.when(waits, none_of(p["approval_state"], WAITS)).otherwise(~done)


def same_availability(x) -> Column:
    return true(x("p").isNotNull() & x("p")["availability_status"].eqNullSafe(x("availability")))


PROVENANCE = (
    Rule("", "unknown value", lambda x: none_of(x("availability"), AVAILABILITY)), Rule(".provenance", "unlike availability", lambda x: ~same_availability(x)), Rule(".provenance", "not approved", lambda x: same_availability(x) & unapproved(x)),
    Rule(".evidence", "missing", lambda x: same_availability(x) & empty(x("p")["evidence"])), Each(".evidence", lambda x: F.when(same_availability(x), F.transform(x("p")["evidence"], lambda e: F.struct(e.alias("e"), may_wait(x).alias("waits")))), evidence_rules()),
)

#: Columns of an event and the approved fields they must equal.
FACTS = {"title_ja": "title", "venue_id": "venue", "date": "eventDate", "open_time": "openTime", "start_time": "startTime"}


def approved_hash(x) -> Column:
    """The hash of all approval hashes of approved fields, sorted."""
    fields = F.filter(F.map_values(x("approved")["fields"]), lambda v: v["approval_state"] == "approved")
    return F.sha2(F.array_join(F.array_sort(F.transform(fields, lambda v: F.coalesce(v["approval_hash"], F.lit("")))), "|"), 256)


def is_approved(x) -> Column:
    return true(x("approved")["review_state"] == "approved")


def unlike(column: str, name: str):
    def broken(x) -> Column:
        f = x("approved")["fields"][name]
        return is_approved(x) & ~true((f["approval_state"] == "approved") & (f["availability_status"] == "published") & x(column).eqNullSafe(f["value"]))

    return broken


APPROVAL = (
    Rule("", "not approved", lambda x: ~is_approved(x)), *[Rule(f".{c}", "unlike what was approved", unlike(c, name)) for c, name in FACTS.items()],
    Rule(".artist_ids", "unlike what was approved", lambda x: is_approved(x) & ~F.array_sort(F.coalesce(x("artist_ids"), F.array())).eqNullSafe(F.array_sort(F.coalesce(x("approved")["fields"]["artist"]["ids"], F.array())))),
    Rule(".verification.evidence_hash", "unlike what was approved", lambda x: is_approved(x) & ~approved_hash(x).eqNullSafe(x("verification")["evidence_hash"])),
)

EVENTS = Table(
    "events", "id",
    (
        missing("id"), *APPROVAL, Rule(".artist_ids", "missing", lambda x: empty(x("artist_ids"))), Rule(".title", "missing", lambda x: blank(x("title_ja")) | blank(x("title_zh"))), Rule(".date", "no date", lambda x: bad_date(x("date"))), Rule(".open_time", "no time", lambda x: bad_time(x("open_time"))),
        Rule(".start_time", "no time", lambda x: bad_time(x("start_time"))), unknown("type", EVENT_TYPES), unknown("status", STATUSES), unknown("event_status", LIFECYCLE), *[Rule(f".{n}", "no list", lambda x, n=n: x(n).isNull()) for n in ("tiers", "additional_fees", "phases", "ticket_links", "ticket_offers", "eligibility")],
        Each(".tiers", lambda x: x("tiers"), [missing("name"), Rule(".price_jpy", "no whole number", lambda x: whole(x("price_jpy")))]), Each(".additional_fees", lambda x: x("additional_fees"), [missing("label"), Rule(".amount_jpy", "no whole number", lambda x: x("amount_jpy").isNotNull() & whole(x("amount_jpy")))]),
        Each(".phases", lambda x: x("phases"), [missing("name"), unknown("kind", PHASE_KINDS), unknown("status", PHASE_STATUSES), Rule("", "no dates", lambda x: bad_date(x("start")) | bad_date(x("end"))), Rule("", "ends before it starts", phase_span), Rule(".url", "no web address", lambda x: ~blank(x("url")) & bad_url(x("url")))]),
        Each(".ticket_links", lambda x: x("ticket_links"), [missing("label"), Rule(".url", "no web address", lambda x: bad_url(x("url"))), unknown("purpose", LINK_PURPOSES)]), Each(".ticket_offers", lambda x: x("ticket_offers"), offer_rules()),
        Each(".ticket_offers", lambda x: F.transform(x("ticket_offers"), lambda o: F.struct(o["event_id"].alias("of"), x("id").alias("own"))), [Rule(".event_id", "of another event", lambda x: ~x("of").eqNullSafe(x("own")))]),
        Rule("", "no availability or provenance", lambda x: x("availability").isNull() | x("field_provenance").isNull()), Each(".fields", provenance, PROVENANCE, lambda x: F.concat(F.lit("."), x["field"])), Rule(".verification", "unproven", lambda x: unproven(x("verification"))),
        Rule(".verification.sources", "missing", lambda x: empty(x("verification")["sources"])), Each(".verification.sources", lambda x: x("verification")["sources"], [Rule("", "missing", lambda x: blank(x("name")) | bad_url(x("url"))), unknown("type", SOURCE_TYPES)]),
    ),
    unique=(Unique("id", lambda x: F.array(x("id")), "duplicate id"), Unique("ticket_offers.id", lambda x: F.transform(F.filter(F.coalesce(x("ticket_offers"), F.array().cast(TICKET)), lambda o: ~blank(o["id"])), lambda o: F.concat_ws("|", x("id"), o["id"])), "duplicate offer")),
    references=(Reference("artist_ids", "artists", lambda x: x("artist_ids"), "unknown artist"), Reference("venue_id", "venues", lambda x: F.array(x("venue_id")), "unknown venue")),
)


def chain_read(x) -> Column:
    return ~F.exists(F.coalesce(x("source_chain"), F.array()), lambda s: true(s["fetch_status"].isin(*UNREAD)))


def undisclosed(x) -> Column:
    """Fields that a source is said not to disclose: field, evidence, and whether the whole chain was read."""
    said = F.filter(F.map_entries(x("fields")), lambda f: true(f["value"]["availability_status"] == "source_does_not_disclose"))
    return F.transform(said, lambda f: F.struct(f["key"].alias("field"), f["value"]["evidence"].alias("evidence"), chain_read(x).alias("read")))


CANDIDATES = Table(
    "candidates", "id",
    (
        missing("id"), Rule(".source_chain", "missing", lambda x: empty(x("source_chain"))), Rule("", "without reason", lambda x: ~true(x("review_state") == "approved") & empty(x("issues"))),
        Each(".source_chain", lambda x: x("source_chain"), [unknown("role", SOURCE_ROLES), Rule("", "no source", lambda x: bad_url(x("url")) | blank(x("source_id"))), Rule("", "success without evidence", lambda x: true(x("fetch_status") == "success") & (blank(x("content_hash")) | x("http_status").isNull()))]),
        Each(".fields", undisclosed, [Rule("", "chain not read", lambda x: ~x("read")), Rule("", "no raw evidence", lambda x: F.exists(F.coalesce(x("evidence"), F.array()), lambda e: empty(e["raw_content_hashes"])))], lambda x: F.concat(F.lit("."), x["field"])),
    ),
    unique=(Unique("id", lambda x: F.array(x("id")), "duplicate id"),),
)

ALL = (ARTISTS, VENUES, EVENTS, CANDIDATES)


def with_approved(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """Events with their approved candidate as `approved`. candidates: id, review_state, fields (as in APPROVED)."""
    return events.drop("approved").join(candidates.select("id", F.struct("review_state", "fields").cast(APPROVED).alias("approved")), "id", "left")


def counts_differ(events: DataFrame, approved: DataFrame) -> DataFrame:
    """One fault where as many events are not published as are approved: table, id, path, rule."""
    n = events.agg(F.count("*").alias("n")).join(approved.agg(F.count("*").alias("m")), F.expr("n <> m"))
    return n.select(F.lit("events").alias("table"), F.lit(None).cast("string").alias("id"), F.lit("").alias("path"), F.concat(F.lit("published "), "n", F.lit(", approved "), "m").alias("rule"))
