"""Queries over the rules of what is published: customers are artists, suppliers venues, orders events with lines as offers, and
documents candidates. All are sound but for planted faults; the SQL states where those are."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo.operators import published_rules as p
from confluo.operators import rules
from confluo.plans.catalogue import query, table

PROOF = "named_struct('state', 'verified', 'evidence_hash', {0}, 'checked_at', '2026-01-01', 'sources', array(named_struct('name', 'site', 'url', 'https://site.example/', 'type', 'artist_official')))"
EVIDENCE = "array(named_struct('source_url', 'https://site.example/', 'source_type', {0}, 'fetched_at', 't', 'verified_at', 't', 'evidence_hash', 'h', 'confidence', {1}, 'availability_status', 'published', 'raw_content_hashes', array(sha2(CAST({2} AS STRING), 256))))"


def typed(df, schema: str):
    """The columns of a schema, in its types; those that df does not have are null."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def artists(spark, d):
    k = "c_custkey"
    return typed(table(spark, d, "customer").selectExpr(
        f"'a' || ({k} - CASE WHEN {k} % 100 = 99 THEN 1 ELSE 0 END) AS id", "c_name AS name_ja", f"CASE WHEN {k} % 7 = 0 THEN NULL WHEN {k} % 50 = 3 THEN ' ' ELSE c_name END AS name_zh", f"CASE WHEN {k} % 7 <> 0 OR {k} % 49 = 0 THEN 'r' END AS romaji", f"CASE WHEN {k} % 7 <> 0 THEN '' END AS kana",
        f"CASE WHEN {k} % 7 = 0 THEN 'minimal' END AS profile_status", f"CASE WHEN {k} % 31 <> 4 THEN array('pop') END AS genres", "c_acctbal AS popularity", f"CASE WHEN {k} % 7 = 0 AND {k} % 3 <> 0 THEN {PROOF.format(repr('h'))} END AS verification",
    ), p.ARTIST)


def venues(spark, d):
    k = "s_suppkey"
    return typed(table(spark, d, "supplier").selectExpr(
        f"'v' || {k} AS id", "s_name AS name_ja", "s_name AS name_zh", f"CASE WHEN {k} % 10 <> 1 THEN 'Tokyo' END AS prefecture", f"CASE WHEN {k} % 10 <> 2 THEN 'c' END AS city", f"CASE WHEN {k} % 10 = 3 THEN 91 ELSE 35 END AS lat", f"CASE WHEN {k} % 10 <> 4 THEN 139 END AS lng", f"CASE {k} % 10 WHEN 5 THEN 0 WHEN 6 THEN 1.5 ELSE 500 END AS capacity",
        f"CASE WHEN {k} % 10 = 7 THEN 'tent' ELSE 'hall' END AS tier", f"CASE WHEN {k} % 10 = 8 THEN 'other' WHEN {k} % 10 = 9 THEN 'budokan' END AS model3d",
    ), p.VENUE)


_F = {"title": "'t' || k", "venue": "'v' || (c % 100)", "eventDate": "day", "openTime": "'17:00'", "startTime": "'18:00'"}
_APPROVED = "map_from_entries(array(" + ", ".join(f"struct('{f}' AS key, named_struct('value', {_F.get(f, 'CAST(NULL AS STRING)')}, 'ids', " + ("array('a' || c)" if f == "artist" else "CAST(NULL AS array<string>)") + f", 'approval_state', 'approved', 'availability_status', 'published', 'approval_hash', '{f}' || k) AS value)" for f in p.REQUIRED) + "))"
_HASH = "sha2(concat_ws('|', array_sort(array(" + ", ".join(f"'{f}' || k" for f in p.REQUIRED) + "))), 256)"


def _null(*names: str) -> str:
    return "".join(f"'{n}', CAST(NULL AS STRING), " for n in names)


def events(spark, d):
    offer = "named_struct('id', 'o' || {0}, 'event_id', 'e' || k, 'provider', 'pia', 'url_kind', 'event_detail', 'sale_type', 'other', 'sale_status', CASE WHEN k % 23 = 1 THEN 'ajar' ELSE 'open' END, 'inventory_status', 'low', 'url', 'https://t.pia.jp/', 'source_url', 'https://t.pia.jp/', 'last_verified_at', CASE WHEN k % 23 = 2 THEN 'soon' ELSE '2026-01-01' END, 'start_at', CASE WHEN k % 23 = 3 THEN 'soon' END, " + _null("end_at", "result_at", "payment_deadline", "ticket_display_at") + "'eligibility', array('m'), " + _null("membership_requirement", "region_restriction", "phone_verification", "companion_restriction", "ticket_distribution") + "'match_level', 'confirmed')"
    proof = "map_from_entries(transform(array(" + ", ".join(map(repr, p.FIELDS)) + "), f -> struct(f AS key, named_struct('availability_status', 'published', 'approval_state', CASE WHEN f = 'prices' AND k % 23 = 4 THEN 'changed' ELSE 'approved' END, 'approval_hash', 'h', 'verified_at', 't', 'evidence', " + EVIDENCE.format("CASE WHEN f = 'venue' AND k % 23 = 5 THEN 'rumour' ELSE 'venue_official' END", "1.0", "k") + ") AS value)))"
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c", "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "o_totalprice AS total")
    # An event takes far longer to make and judge than its order to read, so orders are dealt out first, and not put together again.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k").selectExpr(
        "'e' || k AS id", "CASE WHEN k % 23 = 6 THEN 'other' ELSE 't' || k END AS title_ja", "'t' AS title_zh", "CASE WHEN k % 23 = 7 THEN array('a' || c, 'a-9') ELSE array('a' || c) END AS artist_ids", "CASE WHEN k % 23 = 8 THEN 'v-1' ELSE 'v' || (c % 100) END AS venue_id", "day AS date", "CASE WHEN k % 23 = 9 THEN '24:00' ELSE '17:00' END AS open_time", "'18:00' AS start_time",
        "'oneman' AS type", "'announced' AS status", "'scheduled' AS event_status", "array(named_struct('name', 'S', 'price_jpy', floor(total)), named_struct('name', CASE WHEN k % 23 = 10 THEN '' ELSE 'A' END, 'price_jpy', CASE WHEN k % 23 = 11 THEN 0.5 ELSE 0 END)) AS tiers", "array(named_struct('label', 'drink', 'amount_jpy', CASE WHEN k % 23 = 12 THEN -1 END)) AS additional_fees",
        "CASE WHEN k % 23 <> 13 THEN array(named_struct('name', 'n', 'kind', 'general', 'status', 'open', 'start', day, 'end', CASE WHEN k % 23 = 14 THEN '1990-01-01' ELSE day END, 'url', '')) END AS phases", "array(named_struct('label', 'l', 'url', 'https://x.example/', 'purpose', 'ticket')) AS ticket_links",
        f"array({offer.format('1')}, {offer.format('CASE WHEN k % 23 = 15 THEN 1 ELSE 2 END')}) AS ticket_offers", "array() AS eligibility", "map_from_arrays(array(" + ", ".join(map(repr, p.FIELDS)) + "), array_repeat('published', 12)) AS availability", f"CASE WHEN k % 23 <> 16 THEN {proof} END AS field_provenance", f"{PROOF.format(_HASH)} AS verification",
        f"CASE WHEN k % 23 <> 17 THEN named_struct('review_state', 'approved', 'fields', {_APPROVED}) END AS approved",
    )
    return typed(rows, p.EVENT)


def candidates(spark, d):
    k = "doc_id"
    return typed(table(spark, d, "documents").selectExpr(
        f"'c' || {k} AS id", f"CASE WHEN {k} % 3 = 0 THEN 'approved' ELSE 'candidate' END AS review_state", f"CASE WHEN {k} % 5 <> 1 THEN array(source) ELSE array() END AS issues", f"array(named_struct('role', 'ticket_detail', 'source_id', CASE WHEN {k} % 11 <> 2 THEN 's' END, 'url', 'https://x.example/', 'fetch_status', CASE WHEN {k} % 13 = 3 THEN 'not_checked' ELSE 'success' END, 'content_hash', 'h', 'http_status', CASE WHEN {k} % 17 <> 4 THEN 200 END)) AS source_chain",
        f"map('title', named_struct('availability_status', CASE WHEN {k} % 2 = 0 THEN 'source_does_not_disclose' ELSE 'published' END, 'evidence', {EVIDENCE.format(repr('artist_official'), '1.0', k)})) AS fields",
    ), p.CANDIDATE)


@query("""SELECT 'artists' AS "table", 'a' || (c_custkey - CASE WHEN c_custkey % 100 = 99 THEN 1 ELSE 0 END) AS id, unnest(list_filter([CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 50 = 3 THEN 'name_zh' END, CASE WHEN c_custkey % 49 = 0 THEN 'romaji' END, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 3 = 0 THEN 'verification' END, CASE WHEN c_custkey % 31 = 4 THEN 'genres' END, CASE WHEN c_acctbal < 0 THEN 'popularity' END], lambda x: x IS NOT NULL)) AS path,
unnest(list_filter([CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 50 = 3 THEN 'missing' END, CASE WHEN c_custkey % 49 = 0 THEN 'known in a minimal profile' END, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 3 = 0 THEN 'minimal profile without proof' END, CASE WHEN c_custkey % 31 = 4 THEN 'no list' END, CASE WHEN c_acctbal < 0 THEN 'negative' END], lambda x: x IS NOT NULL)) AS rule FROM customer
UNION ALL SELECT 'artists', 'a' || (c_custkey - 1), 'id=a' || (c_custkey - 1), 'duplicate id' FROM customer WHERE c_custkey % 100 = 99""")
def artist_faults(spark, d):
    return rules.violations({"artists": artists(spark, d)}, [p.ARTISTS])


@query("""SELECT 'venues' AS "table", 'v' || s_suppkey AS id, CASE s_suppkey % 10 WHEN 1 THEN 'prefecture' WHEN 2 THEN 'city' WHEN 3 THEN 'lat' WHEN 4 THEN 'lng' WHEN 7 THEN 'tier' WHEN 8 THEN 'model3d' ELSE 'capacity' END AS path,
CASE s_suppkey % 10 WHEN 1 THEN 'missing' WHEN 2 THEN 'missing' WHEN 3 THEN 'out of range' WHEN 4 THEN 'out of range' WHEN 7 THEN 'unknown value' WHEN 8 THEN 'unknown value' ELSE 'no positive number' END AS rule FROM supplier WHERE s_suppkey % 10 BETWEEN 1 AND 8""")
def venue_faults(spark, d):
    return rules.violations({"venues": venues(spark, d)}, [p.VENUES])


_SPOTS = {
    1: [("ticket_offers[0].sale_status", "unknown value"), ("ticket_offers[1].sale_status", "unknown value")], 2: [("ticket_offers[0].last_verified_at", "no time"), ("ticket_offers[1].last_verified_at", "no time")], 3: [("ticket_offers[0].start_at", "no time"), ("ticket_offers[1].start_at", "no time")], 4: [("fields.prices.provenance", "not approved")],
    5: [("fields.venue.evidence[0]", "incomplete evidence")], 6: [("title_ja", "unlike what was approved")], 7: [("artist_ids", "unlike what was approved"), ("artist_ids[1]", "unknown artist")], 8: [("venue_id", "unlike what was approved"), ("venue_id[0]", "unknown venue")], 9: [("open_time", "unlike what was approved"), ("open_time", "no time")],
    10: [("tiers[1].name", "missing")], 11: [("tiers[1].price_jpy", "no whole number")], 12: [("additional_fees[0].amount_jpy", "no whole number")], 13: [("phases", "no list")], 14: [("phases[0]", "ends before it starts")], 16: [("", "no availability or provenance")], 17: [("", "not approved")],
}
_SPOT_ROWS = ", ".join(f"({m}, '{path}', '{rule}')" for m, spots in _SPOTS.items() for path, rule in spots)


@query(f"""WITH s(m, path, rule) AS (VALUES {_SPOT_ROWS}), a AS (SELECT DISTINCT c_custkey - CASE WHEN c_custkey % 100 = 99 THEN 1 ELSE 0 END AS c FROM customer)
SELECT 'events' AS "table", 'e' || o_orderkey AS id, path, rule FROM orders JOIN s ON o_orderkey % 23 = m UNION ALL SELECT 'events', 'e' || o_orderkey, 'ticket_offers.id=e' || o_orderkey || '|o1', 'duplicate offer' FROM orders WHERE o_orderkey % 23 = 15
UNION ALL SELECT 'events', 'e' || o_orderkey, 'artist_ids[0]', 'unknown artist' FROM orders WHERE o_custkey NOT IN (SELECT c FROM a)
UNION ALL SELECT 'events', 'e' || o_orderkey, 'venue_id[0]', 'unknown venue' FROM orders WHERE o_orderkey % 23 <> 8 AND o_custkey % 100 NOT IN (SELECT s_suppkey FROM supplier)""")
def event_faults(spark, d):
    """Faults of events, of all they hold, and of what they refer to."""
    frames = {"artists": artists(spark, d), "venues": venues(spark, d), "events": events(spark, d)}
    only = [rules.Table("artists", "id"), rules.Table("venues", "id"), p.EVENTS]
    return rules.violations(frames, only)


@query("""SELECT 'candidates' AS "table", 'c' || doc_id AS id, f.path, f.rule FROM (SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 = 1 THEN {'path': '', 'rule': 'without reason'} END, CASE WHEN doc_id % 11 = 2 THEN {'path': 'source_chain[0]', 'rule': 'no source'} END,
CASE WHEN doc_id % 17 = 4 AND doc_id % 13 <> 3 THEN {'path': 'source_chain[0]', 'rule': 'success without evidence'} END, CASE WHEN doc_id % 2 = 0 AND doc_id % 13 = 3 THEN {'path': 'fields.title', 'rule': 'chain not read'} END], lambda x: x IS NOT NULL)) AS f FROM documents)""")
def candidate_faults(spark, d):
    return rules.violations({"candidates": candidates(spark, d)}, [p.CANDIDATES])
