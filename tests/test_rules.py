"""The rules of what is published: a sound row has no fault, and each planted fault is found where it is, and no other."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from confluo.operators import published_rules as p
from confluo.operators import rules

HASH = "a" * 64
EVIDENCE = {"source_url": "https://a.example/", "source_type": "artist_official", "fetched_at": "t", "verified_at": "t", "evidence_hash": "h", "confidence": 1.0, "availability_status": "published", "raw_content_hashes": [HASH]}
SOURCES = [{"name": "n", "url": "http://x.example", "type": "venue_official"}]
VERIFIED = {"state": "verified", "evidence_hash": "h", "checked_at": "t", "sources": SOURCES}
ARTIST = {"id": "a1", "name_ja": "n", "name_zh": "n", "romaji": "r", "kana": "", "genres": [], "popularity": 0.5}
VENUE = {"id": "v1", "name_ja": "n", "name_zh": "n", "prefecture": "p", "city": "c", "lat": 1.0, "lng": 2.0, "capacity": 100.0, "tier": "hall", "model3d": "budokan"}
OFFER = {"id": "o1", "event_id": "e1", "provider": "pia", "url_kind": "search", "sale_type": "other", "sale_status": "open", "inventory_status": "low", "url": "https://t.pia.jp/", "source_url": "https://t.pia.jp/", "last_verified_at": "2026-01-01T00:00:00Z", "start_at": "2026-01-01", "eligibility": [], "match_level": "confirmed"}
FACTS = {"title": "t", "venue": "v1", "eventDate": "2026-02-28", "openTime": "17:00", "startTime": "18:00"}
APPROVED = {"review_state": "approved", "fields": {f: {"value": FACTS.get(f), "ids": ["a1", "a2"] if f == "artist" else None, "approval_state": "approved", "availability_status": "published", "approval_hash": f"h-{f}"} for f in p.REQUIRED}}
EVENT = {
    "id": "e1", "title_ja": "t", "title_zh": "t", "artist_ids": ["a2", "a1"], "venue_id": "v1", "date": "2026-02-28", "open_time": "17:00", "start_time": "18:00", "type": "fes", "status": "ended", "event_status": "scheduled", "tiers": [{"name": "S", "price_jpy": 0.0}], "additional_fees": [{"label": "l", "amount_jpy": None}],
    "phases": [{"name": "n", "kind": "general", "status": "open", "start": "2026-01-01", "end": "2026-01-01", "url": None}], "ticket_links": [{"label": "l", "url": "https://x.example/", "purpose": "ticket"}], "ticket_offers": [OFFER], "eligibility": [], "availability": {f: "published" for f in p.FIELDS},
    "field_provenance": {f: {"availability_status": "published", "approval_state": "approved", "approval_hash": "h", "verified_at": "t", "evidence": [EVIDENCE]} for f in p.FIELDS}, "verification": VERIFIED | {"evidence_hash": hashlib.sha256("|".join(sorted(f"h-{f}" for f in p.REQUIRED)).encode()).hexdigest()}, "approved": APPROVED,
}
CANDIDATE = {"id": "c1", "review_state": "approved", "issues": [], "source_chain": [{"role": "ticket_detail", "source_id": "s", "url": "https://x.example/", "fetch_status": "success", "content_hash": "h", "http_status": 200}], "fields": {"title": {"availability_status": "source_does_not_disclose", "evidence": [EVIDENCE]}}}
MINIMAL = {"profile_status": "minimal", "name_zh": None, "romaji": None, "kana": None, "verification": VERIFIED}
MINIMAL_VENUE = {"profile_status": "minimal", "name_zh": None, "city": None, "lat": None, "lng": None, "capacity": None, "tier": None, "verification": VERIFIED}


def changed(row, path, value):
    out = json.loads(json.dumps(row))  # no two parts are one object
    at = out
    *way, last = path.split("/")
    for k in way:
        at = at[int(k) if isinstance(at, list) else k]
    at[int(last) if isinstance(at, list) else last] = value
    return out


OTHER_ROWS = {"artists": [MINIMAL | {"id": "a1", "name_ja": "n", "genres": []}], "venues": [MINIMAL_VENUE | {"id": "v1", "name_ja": "n", "prefecture": "p"}]}
FAULTS = {
    "artists": (p.ARTISTS, p.ARTIST, ARTIST, [
        ("name_ja", " ", "name_ja", "missing"), ("name_zh", "", "name_zh", "missing"), ("romaji", None, "romaji", "missing"), ("kana", None, "kana", "null"), ("genres", None, "genres", "no list"), ("popularity", -1.0, "popularity", "negative"), ("popularity", float("nan"), "popularity", "negative"),
    ]),
    "minimal artists": (p.ARTISTS, p.ARTIST, ARTIST | MINIMAL, [(f, "x", f, "known in a minimal profile") for f in ("name_zh", "romaji", "kana")] + [(f"verification/{f}", v, "verification", "minimal profile without proof") for f, v in (("state", "no"), ("checked_at", ""), ("evidence_hash", None), ("sources", []))] + [("verification", None, "verification", "minimal profile without proof")]),
    "venues": (p.VENUES, p.VENUE, VENUE, [
        ("prefecture", None, "prefecture", "missing"), ("city", " ", "city", "missing"), ("lat", 90.5, "lat", "out of range"), ("lat", None, "lat", "out of range"), ("lng", -181.0, "lng", "out of range"), ("capacity", 0.0, "capacity", "no positive number"), ("capacity", 1.5, "capacity", "no positive number"), ("tier", "tent", "tier", "unknown value"), ("model3d", "x", "model3d", "unknown value"),
    ]),
    "minimal venues": (p.VENUES, p.VENUE, VENUE | MINIMAL_VENUE, [("capacity", 5.0, "capacity", "known in a minimal profile"), ("city", "", "city", "empty"), ("verification/sources", None, "verification", "minimal profile without proof")]),
    "events": (p.EVENTS, p.EVENT, EVENT, [
        ("approved", None, "", "not approved"), ("approved/review_state", "candidate", "", "not approved"), ("approved/fields/title/value", "u", "title_ja", "unlike what was approved"), ("approved/fields/venue/availability_status", "blocked", "venue_id", "unlike what was approved"), ("approved/fields/artist/ids", ["a1"], "artist_ids", "unlike what was approved"),
        ("approved/fields/openTime/availability_status", "blocked", "open_time", "unlike what was approved"), ("verification/evidence_hash", "x", "verification.evidence_hash", "unlike what was approved"), ("title_zh", "", "title", "missing"), ("type", None, "type", "unknown value"), ("status", "gone", "status", "unknown value"), ("event_status", "x", "event_status", "unknown value"),
        ("tiers/0/name", "", "tiers[0].name", "missing"), ("tiers/0/price_jpy", 1.5, "tiers[0].price_jpy", "no whole number"), ("tiers/0/price_jpy", None, "tiers[0].price_jpy", "no whole number"), ("additional_fees/0/amount_jpy", -1.0, "additional_fees[0].amount_jpy", "no whole number"), ("additional_fees/0/label", None, "additional_fees[0].label", "missing"), ("phases", None, "phases", "no list"),
        ("phases/0/kind", "x", "phases[0].kind", "unknown value"), ("phases/0/start", "2026-02-30", "phases[0]", "no dates"), ("phases/0/end", "2025-12-31", "phases[0]", "ends before it starts"), ("phases/0/url", "ftp://x", "phases[0].url", "no web address"), ("phases/0/status", None, "phases[0].status", "unknown value"), ("ticket_links/0/purpose", "x", "ticket_links[0].purpose", "unknown value"),
        ("ticket_links/0/url", None, "ticket_links[0].url", "no web address"), ("ticket_offers/0/id", "", "ticket_offers[0].id", "missing"), ("ticket_offers/0/event_id", "e2", "ticket_offers[0].event_id", "of another event"), ("ticket_offers/0/event_id", None, "ticket_offers[0].event_id", "of another event"), ("ticket_offers/0/provider", "x", "ticket_offers[0].provider", "unknown value"),
        ("ticket_offers/0/source_url", "x", "ticket_offers[0].url", "no web address"), ("ticket_offers/0/last_verified_at", "soon", "ticket_offers[0].last_verified_at", "no time"), ("ticket_offers/0/start_at", "soon", "ticket_offers[0].start_at", "no time"), ("ticket_offers/0/eligibility", None, "ticket_offers[0].eligibility", "no list"), ("ticket_offers/0/phone_verification", " ", "ticket_offers[0].phone_verification", "empty"),
        ("ticket_offers/0/match_level", "unmatched", "ticket_offers[0].match_level", "unknown value"), ("field_provenance/title/approval_hash", "", "fields.title.provenance", "not approved"), ("field_provenance/prices/approval_state", "pending_review", "fields.prices.provenance", "not approved"), ("field_provenance/prices/availability_status", "blocked", "fields.prices.provenance", "unlike availability"),
        ("field_provenance/venue/evidence", [], "fields.venue.evidence", "missing"), ("field_provenance/venue/evidence/0/confidence", 1.5, "fields.venue.evidence[0]", "incomplete evidence"), ("field_provenance/venue/evidence/0/verified_at", None, "fields.venue.evidence[0]", "incomplete evidence"), ("field_provenance/venue/evidence/0/raw_content_hashes", ["A" * 64], "fields.venue.evidence[0].raw_content_hashes", "no raw evidence"),
        ("field_provenance/venue/evidence/0/raw_content_hashes", None, "fields.venue.evidence[0].raw_content_hashes", "no raw evidence"), ("field_provenance", None, "", "no availability or provenance"), ("verification/sources", [], "verification.sources", "missing"), ("verification/sources/0/type", "x", "verification.sources[0].type", "unknown value"), ("verification/sources/0/url", "x", "verification.sources[0]", "missing"), ("verification/checked_at", None, "verification", "unproven"),
    ]),
    "candidates": (p.CANDIDATES, p.CANDIDATE, CANDIDATE, [
        ("source_chain", [], "source_chain", "missing"), ("review_state", "candidate", "", "without reason"), ("source_chain/0/role", "x", "source_chain[0].role", "unknown value"), ("source_chain/0/source_id", "", "source_chain[0]", "no source"), ("source_chain/0/http_status", None, "source_chain[0]", "success without evidence"),
        ("source_chain/0/fetch_status", "parser_failed", "fields.title", "chain not read"), ("fields/title/evidence/0/raw_content_hashes", [], "fields.title", "no raw evidence"),
    ]),
}


@pytest.mark.parametrize("name", FAULTS)
def test_each_fault_alone(spark, name):
    table, schema, sound, cases = FAULTS[name]
    rows = [sound] + [changed(sound, path, value) for path, value, *_ in cases]
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(rows)], f"case string, r struct<{schema}>").select("case", "r.*").withColumnRenamed("id", "own").withColumn("id", F.col("own"))
    keyed = rules.Table(table.name, "case", table.rules)
    got = {}
    for r in rules.row_faults(df, keyed).collect():
        got.setdefault(int(r.id), []).append((r.path, r.rule))
    assert 0 not in got, got[0]
    assert [(path, value, got.get(i)) for i, (path, value, *want) in enumerate(cases, 1) if got.get(i) != [tuple(want)]] == []


def test_fields_may_wait_unless_required(spark):
    def of(field, state, availability):
        row = changed(changed(EVENT, f"availability/{field}", availability), f"field_provenance/{field}", EVENT["field_provenance"][field] | {"availability_status": availability, "approval_state": state, "approval_hash": None, "evidence": [EVIDENCE | {"verified_at": None}]})
        return [(r.path, r.rule) for r in rules.row_faults(spark.createDataFrame([row], p.EVENT), p.EVENTS).collect()]

    assert of("prices", "pending_review", "parser_failed") == []
    assert of("prices", "approved", "parser_failed") == [("fields.prices.provenance", "not approved")]
    assert set(of("venue", "pending_review", "parser_failed")) == {("fields.venue.provenance", "not approved"), ("fields.venue.evidence[0]", "incomplete evidence")}


def test_uniqueness_and_references(spark):
    frames = {
        "artists": spark.createDataFrame([ARTIST, ARTIST | {"id": "a2"}, ARTIST | {"id": "a2"}], p.ARTIST), "venues": spark.createDataFrame([VENUE], p.VENUE), "candidates": spark.createDataFrame([], p.CANDIDATE),
        "events": spark.createDataFrame([EVENT, EVENT | {"id": "e2", "artist_ids": ["a1", "a9", None], "venue_id": None, "ticket_offers": [OFFER | {"event_id": "e2"}, OFFER | {"event_id": "e2"}]}], p.EVENT),
    }
    got = {tuple(r) for r in rules.violations(frames, p.ALL).collect()}
    assert got == {("artists", "a2", "id=a2", "duplicate id"), ("events", "e2", "artist_ids[1]", "unknown artist"), ("events", "e2", "artist_ids[2]", "unknown artist"), ("events", "e2", "artist_ids", "unlike what was approved"), ("events", "e2", "venue_id", "unlike what was approved"), ("events", "e2", "venue_id[0]", "unknown venue"), ("events", "e2", "ticket_offers.id=e2|o1", "duplicate offer")}


def test_approved_candidates_and_counts(spark):
    events = spark.createDataFrame([EVENT, EVENT | {"id": "e2", "ticket_offers": []}], p.EVENT)
    candidates = spark.createDataFrame([("e1", "approved", APPROVED["fields"])], "id string, review_state string, fields map<string, struct<value: string, ids: array<string>, approval_state: string, availability_status: string, approval_hash: string>>")
    found = rules.row_faults(p.with_approved(events, candidates), p.EVENTS)
    assert [(r.id, r.rule) for r in found.collect()] == [("e2", "not approved")]
    assert [r.rule for r in p.counts_differ(events, candidates).collect()] == ["published 2, approved 1"]
    assert p.counts_differ(events, events).count() == 0


def test_rules_are_stated_once(spark):
    """Spark must not filter by what is exploded: it would evaluate all rules, and what makes their rows, again."""
    made = spark.range(5).select(F.concat(F.lit("e"), F.col("id")).alias("id"), F.transform(F.sequence(F.lit(0), F.col("id")), lambda i: i.cast("string")).alias("ids"))
    table = rules.Table("t", "id", (rules.Rule(".ids", "many", lambda x: F.size(x("ids")) > 3),), unique=(rules.Unique("ids", lambda x: x("ids")),))
    for found, n in ((rules.row_faults(made, table), 2), (rules.watched(made, table, table.unique), 15)):
        assert "Filter" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert found.count() == n
