"""Queries over scans of stored pages and over the store of responses: each page of `pages` is a response, in 25 sources."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from confluo.plans.catalogue import query, table
from confluo.sources import evidence, scan
from confluo.sources.folders import scratch

LINK = re.compile(r'href="([^"]*)"')


def links(body, url):
    """A parser that fails on a page without a body."""
    return [{"link": x, "site": url} for x in LINK.findall(body)]


def sources(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_nationkey").cast("long").alias("source_id"), F.col("n_name").alias("name"), F.expr("CASE WHEN n_nationkey % 8 = 7 THEN 'no key' END AS skipped"))


def stored_pages(spark, d):
    """Pages of sources 3 and 11 lack a body now and then, those of source 19 name a parser that there is not."""
    own = table(spark, d, "pages").withColumn("source_id", F.col("page_id") % 25)
    lost = (F.col("source_id").isin(3, 11)) & (F.col("page_id") % 4 == 1)
    return own.select("source_id", F.col("page_id").alias("page"), "url", F.when(F.col("source_id") == 19, "other").otherwise("links").alias("parser_id"), F.when(~lost, F.coalesce("html", F.lit(""))).alias("body"))


def scanned(spark, d):
    return scan.scan(sources(spark, d), stored_pages(spark, d), {"links": links}, "link string, site string")


_SCAN = """WITH p AS (SELECT page_id % 25 AS source_id, page_id AS page, url, coalesce(html, '') AS html, CASE WHEN page_id % 25 IN (3, 11) AND page_id % 4 = 1 THEN 'TypeError: expected string or bytes-like object, got ''NoneType''' WHEN page_id % 25 = 19 THEN 'LookupError: no parser other' END AS error FROM pages JOIN nation ON n_nationkey = page_id % 25 WHERE n_nationkey % 8 <> 7),
l AS (SELECT *, CASE WHEN error IS NULL THEN regexp_extract_all(html, 'href="([^"]*)"', 1) ELSE [] END AS links FROM p),
s AS (SELECT n_nationkey AS source_id, n_name AS name, min_by(error, page) FILTER (error IS NOT NULL) AS error, coalesce(sum(len(links)), 0) AS n FROM nation LEFT JOIN l ON l.source_id = n_nationkey GROUP BY 1, 2)"""


@query(f"{_SCAN} SELECT l.source_id, page, CAST(generate_subscripts(links, 1) - 1 AS INTEGER) AS n, unnest(links) AS link, url AS site FROM l JOIN s ON s.source_id = l.source_id AND s.error IS NULL")
def scanned_records(spark, d):
    """Records of all sources that could be read whole."""
    return scanned(spark, d)[0].drop("url")


@query(f"{_SCAN} SELECT CAST(source_id AS BIGINT) AS seq, CAST(source_id AS BIGINT) AS source_id, name, CASE WHEN source_id % 8 = 7 THEN 'skipped' WHEN error IS NOT NULL THEN 'failed' ELSE 'ok' END AS status, CAST(CASE WHEN error IS NULL AND source_id % 8 <> 7 THEN n ELSE 0 END AS BIGINT) AS record_count, CASE WHEN source_id % 8 = 7 THEN 'no key' END AS reason, error FROM s")
def scan_results(spark, d):
    """How the scan of each source went; one that failed stops no other."""
    return scan.refuse_if_all_failed(scanned(spark, d)[1])


@query(f"{_SCAN} SELECT source_id, page, url, CASE WHEN source_id = 19 THEN 'other' ELSE 'links' END AS parser_id, CASE WHEN error IS NULL THEN 'success' ELSE 'parser_failed' END AS status, error, CAST(len(links) AS BIGINT) AS output_count FROM l")
def scan_pages(spark, d):
    """What the parser said of each page."""
    return scanned(spark, d)[2]


def responses(spark, d):
    """Every page as a response of its first or second attempt: one of seven was not fetched, one of eleven is an error page."""
    k = F.col("page_id")
    got = k % 7 != 6
    return table(spark, d, "pages").select(
        F.concat(F.lit("source "), (k % 25).cast("string")).alias("source_id"), F.lit("b1").alias("batch_id"), F.when(k % 13 == 5, "rumour").otherwise("venue_detail").alias("source_role"), F.when(k % 17 == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("links"))).alias("parser_ids"), F.lit("1").alias("parser_version"), F.col("url").alias("requested_url"),
        F.when(got & (k % 5 == 0), F.concat("url", F.lit("#moved"))).alias("canonical_url"), (k % 2).cast("int").alias("attempt"), F.when(k % 11 == 4, 503).otherwise(200).alias("http_status"), F.when(k % 3 == 0, "application/xhtml+xml").otherwise("text/html").alias("content_type"), F.lit("2026-06-01T00:00:00Z").alias("fetched_at"),
        F.when(got, F.coalesce("html", F.lit("")).cast("binary")).alias("body"), F.when(~got, "timeout").alias("error"),
    )


_ENTRY = """WITH r AS (SELECT page_id AS k, 'source ' || page_id % 25 AS source_id, url, coalesce(html, '') AS body, page_id % 7 <> 6 AS got, CASE WHEN page_id % 5 = 0 THEN url || '#moved' ELSE url END AS final, page_id % 2 AS attempt FROM pages),
e AS (SELECT *, CASE WHEN got THEN sha256(body) END AS hash, CASE WHEN got THEN sha256(body) || '.' || substr(sha256(url || '|' || final || '|' || attempt), 1, 12) ELSE sha256(url || '|' || source_id || '|' || attempt || '|timeout') || '.fetch-failed' END AS entry FROM r)"""


@query(f"""{_ENTRY} SELECT source_id, url AS requested_url, CASE WHEN got THEN final END AS canonical_url, CAST(attempt AS INTEGER) AS attempt, CAST(CASE WHEN got THEN CASE WHEN k % 11 = 4 THEN 503 ELSE 200 END END AS INTEGER) AS http_status, hash AS content_hash, entry,
CASE WHEN NOT got THEN 'page_fetch_failed' WHEN k % 11 = 4 THEN 'http_error' ELSE 'success' END AS fetch_status, CASE WHEN got THEN 'not_recorded' ELSE 'not_run' END AS parser_status, CASE WHEN got THEN '' ELSE 'timeout' END AS errors, got AND k % 5 = 0 AS redirected, CASE WHEN got THEN 'raw/source-' || k % 25 || '/b1/' || hash || '.html' END AS raw_file FROM e""")
def evidence_entries(spark, d):
    """An entry for each response, failures included, by hashes of body and request."""
    out = evidence.entries_of(responses(spark, d))
    return out.select("source_id", "requested_url", "canonical_url", "attempt", "http_status", "content_hash", "entry", "fetch_status", "parser_status", F.array_join("parser_errors", ", ").alias("errors"), "redirected", "raw_file")


@query(f"""{_ENTRY}, d AS (SELECT DISTINCT source_id, entry, hash FROM e)
SELECT hash AS content_hash, CAST(1 AS BIGINT) AS bodies, count(*) AS entries, min(source_id) AS first_source, TRUE AS intact FROM d WHERE hash IS NOT NULL GROUP BY hash""")
def evidence_once(spark, d):
    """The store after all responses were added twice, then half of them again: a body a hash, an entry an attempt, hashes intact."""
    store = evidence.EvidenceStore(spark, scratch(spark, "evidence"))
    rows = responses(spark, d)
    for some in (rows, rows, rows.filter("attempt = 1")):
        store.add(some)
    bodies = spark.read.parquet(f"{store.root}/bodies").groupBy("content_hash").agg(F.count("*").alias("bodies"), F.bool_and(F.sha2("body", 256) == F.col("content_hash")).alias("intact"))
    entries = spark.read.parquet(f"{store.root}/entries").filter("content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("entries"), F.min("source_id").alias("first_source"))
    return entries.join(bodies, "content_hash").select("content_hash", "bodies", "entries", "first_source", "intact")


def results_of_parsers(spark, d):
    k = F.col("page_id")
    rows = table(spark, d, "pages").filter("page_id % 3 <> 0").select(
        k.alias("seq"), F.concat(F.lit("source "), (k % 25).cast("string")).alias("source_id"), F.col("url"), F.lit("links").alias("parser_id"), F.when(k % 2 == 0, "success").otherwise("parser_failed").alias("status"), F.when(k % 2 == 1, "no list").alias("error"), (k % 4).alias("output_count"),
    )
    return rows


@query(f"""{_ENTRY}, p AS (SELECT source_id, url, max_by(k, k) AS last, max_by(k % 4, k) AS output_count, count(*) FILTER (k % 2 = 1) AS bad FROM r WHERE k % 3 <> 0 GROUP BY 1, 2), u AS (SELECT DISTINCT source_id, entry, url, got FROM e)
SELECT u.source_id, entry, coalesce(CASE WHEN last IS NOT NULL THEN CASE WHEN last % 2 = 0 THEN 'success' ELSE 'parser_failed' END END, CASE WHEN got THEN 'not_recorded' ELSE 'not_run' END) AS parser_status, output_count,
CASE WHEN got THEN '' ELSE 'timeout' END || CASE WHEN NOT got AND coalesce(bad, 0) > 0 THEN ', ' ELSE '' END || CASE WHEN coalesce(bad, 0) > 0 THEN 'links: no list' ELSE '' END AS errors FROM u LEFT JOIN p ON p.source_id = u.source_id AND p.url = u.url""")
def parsed_evidence(spark, d):
    """Entries with the last word of their parser and its errors."""
    entries = evidence.entries_of(responses(spark, d)).select(*evidence.ENTRY).dropDuplicates(["source_id", "batch_id", "entry"])
    out = evidence.with_parser_results(entries, results_of_parsers(spark, d))
    return out.select("source_id", "entry", "parser_status", "output_count", F.array_join("parser_errors", ", ").alias("errors"))


@query(f"""{_ENTRY}, a AS (SELECT source_id, hash, entry, got, k, got AND k % 11 <> 4 AS good FROM e), b AS (SELECT hash, bool_or(k % 10 = 1) AS gone, bool_or(k % 10 = 2) AS changed FROM a WHERE got GROUP BY hash),
v AS (SELECT a.*, coalesce(gone, FALSE) AS gone, coalesce(changed, FALSE) AS changed FROM a LEFT JOIN b ON a.hash = b.hash)
SELECT source_id, entry, 'metadata' AS rule FROM v WHERE k % 13 = 5 OR k % 17 = 3 UNION ALL SELECT source_id, entry, 'body missing' FROM v WHERE good AND gone UNION ALL SELECT source_id, entry, 'body changed' FROM v WHERE good AND NOT gone AND changed UNION ALL SELECT source_id, entry, 'parser not recorded' FROM v WHERE good""")
def manifest_faults(spark, d):
    """Entries that break a rule of manifests; some bodies are gone, others no longer what was fetched."""
    rows = evidence.entries_of(responses(spark, d))
    flags = table(spark, d, "pages").filter("page_id % 7 <> 6").select(F.sha2(F.coalesce("html", F.lit("")), 256).alias("content_hash"), F.coalesce("html", F.lit("")).cast("binary").alias("body"), (F.col("page_id") % 10 == 1).alias("gone"), (F.col("page_id") % 10 == 2).alias("changed"))
    bodies = flags.groupBy("content_hash").agg(F.any_value("body").alias("body"), F.bool_or("gone").alias("gone"), F.bool_or("changed").alias("changed")).filter("not gone")
    bodies = bodies.select("content_hash", F.when(F.col("changed"), F.concat("body", F.lit("!").cast("binary"))).otherwise(F.col("body")).alias("body"))
    return evidence.incomplete(rows, bodies, ["venue_detail", "venue_schedule"]).select("source_id", "entry", "rule")
