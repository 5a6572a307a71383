"""Queries that enrich listed shows by their detail pages: orders are the lists, customers the pages, several shows to a page.
The SQL states the rules field by field."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo.plans.catalogue import query, table
from confluo.sources import enrich

SITE = "https://hall.example/show/"
FEES, RULES = "array<struct<type:string,amount_jpy:bigint>>", "array<struct<label:string>>"
TICKETS = "array<struct<name:string,price_jpy:bigint>>"


def listed_shows(spark, d):
    """Every order as a row of a list: with and without times, tickets, links and earlier errors."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("show_id"), F.expr(f"'{SITE}' || o_custkey AS source_url"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '16:00' END AS open_time"), F.expr("CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '19:00' ELSE '18:30' END AS start_time"),
        F.lit(None).cast("string").alias("ticket_url"), F.expr(f"CAST(CASE WHEN o_orderkey % 2 = 0 THEN array(named_struct('name', 'list', 'price_jpy', CAST(floor(o_totalprice) AS BIGINT))) ELSE array() END AS {TICKETS}) AS ticket_types"),
        F.expr("CAST(CASE WHEN o_orderkey % 2 = 0 THEN array(CAST(floor(o_totalprice) AS BIGINT)) END AS array<bigint>) AS prices_jpy"), F.lit(None).cast(FEES).alias("additional_fees"), F.lit(None).cast(RULES).alias("eligibility"),
        F.expr("CAST(CASE WHEN o_orderkey % 4 = 0 THEN array('https://t.example/' || o_custkey % 7, 'https://t.example/' || o_custkey % 7) ELSE array() END AS array<string>) AS purchase_urls"), F.array(F.struct(F.lit("venue_schedule").alias("role"), F.lit("lists").alias("source_id"), F.lit("u").alias("url"), F.lit("success").alias("fetch_status"), *[F.lit(None).alias(c) for c in ("content_hash", "content_type", "http_status", "fetched_at")])).cast(enrich.LISTED["source_chain"]).alias("source_chain"),
        F.expr("map('title', 'published', 'ticketTypes', CASE WHEN o_orderkey % 2 = 0 THEN 'published' ELSE 'not_checked' END, 'eligibility', 'not_checked') AS field_availability"), F.expr("CASE WHEN o_orderkey % 6 = 0 THEN array('list: odd row') END AS parser_errors"), F.lit("old").alias("content_hash"),
    )


def detail_pages(spark, d):
    """A page for five of six customers, a later one for some: read with all facts, with none, with two starts, not fetched, not read."""
    rows = table(spark, d, "customer").filter("c_custkey % 6 <> 5").withColumn("seq", F.explode(F.expr("CASE WHEN c_custkey % 10 = 0 THEN array(0, 1) ELSE array(1) END")))
    whole = "seq = 1 AND c_custkey % 6 IN (0, 4)"
    when = lambda kind, made: F.expr(f"CAST(CASE WHEN {whole} THEN {made} ELSE array() END AS {kind})")
    return rows.select(
        "seq", F.expr(f"'{SITE}' || c_custkey AS url"), F.expr("seq = 1 AND c_custkey % 6 IN (0, 1, 4) AS ok"), F.expr("CASE WHEN seq = 0 THEN 'earlier' WHEN c_custkey % 6 = 2 THEN 'timeout' WHEN c_custkey % 6 = 3 THEN 'layout changed' END AS reason"), F.expr("CASE WHEN c_custkey % 6 = 2 THEN 'page_fetch_failed' END AS availability"),
        when("array<struct<role:string,url:string>>", "array(named_struct('role', 'artist_official', 'url', 'https://a.example/' || c_nationkey))").alias("links"), F.expr("CAST(CASE WHEN seq = 1 AND c_custkey % 6 = 4 THEN array('12:00', '17:30') WHEN seq = 1 AND c_custkey % 6 = 0 THEN array('17:00') ELSE array() END AS array<string>) AS open_times"),
        F.expr("CAST(CASE WHEN seq = 1 AND c_custkey % 6 = 4 THEN array('13:00', '18:30') WHEN seq = 1 AND c_custkey % 6 = 0 THEN array('18:00') ELSE array() END AS array<string>) AS start_times"), F.sha2(F.col("c_name"), 256).alias("content_hash"), F.lit("text/html").alias("content_type"), F.expr("CASE WHEN c_custkey % 6 <> 2 THEN 200 END AS http_status"), F.lit("2026-06-01").alias("fetched_at"),
        when(TICKETS, "array(named_struct('name', 'page', 'price_jpy', CAST(floor(c_acctbal) AS BIGINT)))").alias("ticket_types"), when("array<bigint>", "array(CAST(floor(c_acctbal) AS BIGINT))").alias("prices_jpy"), when(FEES, "array(named_struct('type', 'drink', 'amount_jpy', 600L))").alias("additional_fees"), when(RULES, "array(named_struct('label', c_mktsegment))").alias("eligibility"),
        F.expr("CAST(CASE WHEN seq = 1 AND c_custkey % 6 IN (0, 3, 4) THEN array('https://t.example/' || c_custkey % 7, 'https://t.example/x' || c_nationkey) ELSE array() END AS array<string>) AS purchase_urls"),
    )


def told(df):
    """What enrichment decides, as plain columns."""
    joined = lambda c, f: F.array_join(F.transform(c, f), ", ")
    fields = F.array_sort(F.map_entries("field_availability"))
    return df.select(
        "show_id", "open_time", "start_time", "ticket_url", joined("ticket_types", lambda x: F.concat_ws("=", x["name"], x["price_jpy"].cast("string"))).alias("ticket_types"), F.array_join(F.col("prices_jpy").cast("array<string>"), ", ").alias("prices"), F.size("additional_fees").alias("n_fees"), joined("eligibility", lambda x: x["label"]).alias("eligibility"),
        F.array_join("purchase_urls", ", ").alias("purchase_urls"), joined("source_chain", lambda x: F.concat_ws(" ", x["role"], x["fetch_status"], x["http_status"].cast("string"), x["url"])).alias("chain"), joined(fields, lambda x: F.concat_ws("=", x["key"], x["value"])).alias("availability"), F.array_join("parser_errors", ", ").alias("errors"), (F.col("content_hash") != "old").alias("rehashed"),
    )


_ROWS = f"""WITH l AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 3 = 2 THEN '16:00' ELSE '' END AS opens, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '19:00' ELSE '18:30' END AS starts, o_orderkey % 3 = 1 AS empty_open, o_orderkey % 5 = 1 AS empty_start, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderkey % 2 = 0 AS priced, o_orderkey % 4 = 0 AS linked, o_orderkey % 6 = 0 AS odd FROM orders),
j AS (SELECT l.*, c_custkey IS NOT NULL AND c % 6 <> 5 AS page, CASE WHEN c % 6 IN (0, 1, 4) THEN 'ok' WHEN c % 6 = 2 THEN 'page_fetch_failed' ELSE 'parser_failed' END AS state, c % 6 IN (0, 4) AS whole, CAST(floor(c_acctbal) AS BIGINT) AS own, c_nationkey AS n, c_mktsegment AS seg, CASE c % 6 WHEN 2 THEN 'timeout' ELSE 'layout changed' END AS reason FROM l LEFT JOIN customer ON c_custkey = c),
s AS (SELECT *, CASE WHEN state = 'ok' THEN 'not_found_on_page' ELSE state END AS silent, '{SITE}' || c AS url FROM j)"""
_CHAIN = """'venue_schedule success u' || CASE WHEN page THEN ', venue_detail ' || CASE WHEN state = 'ok' THEN 'success' ELSE state END || CASE WHEN c % 6 <> 2 THEN ' 200' ELSE '' END || ' ' || url ELSE '' END || CASE WHEN page AND whole THEN ', artist_official not_checked https://a.example/' || n ELSE '' END AS chain"""
_SAME = f"""CASE WHEN page AND whole THEN 'page=' || own WHEN priced THEN 'list=' || price ELSE '' END AS ticket_types, CASE WHEN page AND whole THEN '' || own WHEN priced THEN '' || price END AS prices, CAST(CASE WHEN page AND state = 'ok' THEN CASE WHEN whole THEN 1 ELSE 0 END END AS INTEGER) AS n_fees,
CASE WHEN page AND state = 'ok' THEN CASE WHEN whole THEN seg ELSE '' END END AS eligibility, {_CHAIN}, page AS rehashed"""
_OLD = "'eligibility=not_checked, ticketTypes=' || CASE WHEN priced THEN 'published' ELSE 'not_checked' END || ', title=published'"


@query(f"""{_ROWS}, t AS (SELECT *, CASE WHEN c % 6 = 4 THEN ['13:00', '18:30'] WHEN c % 6 = 0 THEN ['18:00'] ELSE [] END AS st, CASE WHEN c % 6 = 4 THEN ['12:00', '17:30'] WHEN c % 6 = 0 THEN ['17:00'] ELSE [] END AS op FROM s)
SELECT k AS show_id, CASE WHEN opens <> '' THEN opens WHEN page AND state = 'ok' THEN CASE WHEN len(st) = 1 OR list_contains(st, starts) THEN op[greatest(1, coalesce(list_position(st, starts), 1))] END WHEN empty_open THEN '' END AS open_time,
CASE WHEN starts <> '' THEN starts WHEN page AND state = 'ok' THEN CASE WHEN len(st) = 1 THEN st[1] END WHEN empty_start THEN '' END AS start_time, CASE WHEN page AND whole THEN 'https://t.example/' || c % 7 END AS ticket_url, {_SAME},
CASE WHEN page AND state = 'ok' THEN CASE WHEN whole THEN 'https://t.example/' || c % 7 || ', https://t.example/x' || n ELSE '' END WHEN linked THEN 'https://t.example/' || c % 7 || ', https://t.example/' || c % 7 ELSE '' END AS purchase_urls,
CASE WHEN NOT page THEN {_OLD} ELSE 'additionalFees=' || mark || ', eligibility=' || mark || CASE WHEN whole THEN ', prices=published' ELSE '' END || ', purchaseUrls=' || mark || ', ticketPhases=' || silent || ', ticketTypes=' || CASE WHEN whole OR priced THEN 'published' ELSE 'not_checked' END || ', title=published' END AS availability,
CASE WHEN page AND state <> 'ok' THEN CASE WHEN odd THEN 'list: odd row, ' ELSE '' END || 'zepp-detail: ' || reason WHEN odd THEN 'list: odd row' END AS errors FROM (SELECT *, CASE WHEN whole THEN 'published' ELSE silent END AS mark FROM t)""")
def enriched_halls(spark, d):
    """Listed shows with what halls' pages say: times where they are unambiguous, lists where they have members."""
    return told(enrich.enrich(listed_shows(spark, d), detail_pages(spark, d), enrich.hall("hall")))


@query(f"""{_ROWS}, m AS (SELECT *, CASE WHEN whole THEN 'published' ELSE silent END AS mark, list_concat(CASE WHEN linked THEN ['https://t.example/' || c % 7] ELSE [] END, CASE WHEN c % 6 IN (0, 3, 4) THEN list_concat(CASE WHEN linked THEN [] ELSE ['https://t.example/' || c % 7] END, ['https://t.example/x' || n]) ELSE [] END) AS urls FROM s)
SELECT k AS show_id, CASE WHEN opens <> '' THEN opens WHEN empty_open THEN '' END AS open_time, CASE WHEN starts <> '' THEN starts WHEN empty_start THEN '' END AS start_time, CAST(NULL AS VARCHAR) AS ticket_url, {_SAME},
CASE WHEN page THEN array_to_string(urls, ', ') WHEN linked THEN 'https://t.example/' || c % 7 || ', https://t.example/' || c % 7 ELSE '' END AS purchase_urls,
CASE WHEN NOT page THEN {_OLD} ELSE 'additionalFees=' || mark || ', eligibility=' || mark || ', prices=' || mark || ', purchaseUrls=' || CASE WHEN len(urls) > 0 THEN 'published' ELSE silent END || ', ticketPhases=' || silent || ', ticketTypes=' || mark || ', title=published' END AS availability,
CASE WHEN page AND state <> 'ok' THEN CASE WHEN odd THEN 'list: odd row, ' ELSE '' END || 'yokohama-detail: ' || reason WHEN odd THEN 'list: odd row' END AS errors FROM m""")
def enriched_arenas(spark, d):
    """Listed shows with what arenas' pages say: links add up, and what a page does not tell is marked by its state."""
    return told(enrich.enrich(listed_shows(spark, d), detail_pages(spark, d), enrich.arena("arena")))


@query(f"""SELECT '{SITE}' || c_custkey AS url, 'detail-html' AS parser_id, CASE WHEN c_custkey % 6 IN (0, 1, 4) THEN 'success' WHEN c_custkey % 6 = 2 THEN 'not_run' ELSE 'parser_failed' END AS status, CASE c_custkey % 6 WHEN 2 THEN 'timeout' WHEN 3 THEN 'layout changed' END AS error,
CAST(c_custkey % 6 IN (0, 1, 4) AS BIGINT) AS output_count FROM customer WHERE c_custkey % 6 <> 5 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey % 100 >= 50)""")
def detail_parser_results(spark, d):
    """How reading went, for the pages that listed shows with an address of one kind name, each once."""
    pages = detail_pages(spark, d).filter("seq = 1")
    wanted = enrich.detail_urls(listed_shows(spark, d), r"/show/\d*[5-9]\d$")
    return enrich.parser_results(pages.join(wanted, "url", "left_semi"), "detail-html")
