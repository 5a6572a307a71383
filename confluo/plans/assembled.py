"""Queries that make events of candidates, and reviews of events: orders are candidates, their lines their tickets and phases."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo.operators import assembly
from confluo.plans.catalogue import query, table
from confluo.sources.folders import written

TODAY, NOW = "1998-06-01", "2026-01-01T00:00:00Z"
#: Fields of every candidate as (name, JSON of the value); which are approved and published goes by the key of the order.
_VALUES = {"title": "to_json(struct(concat('approved ', k) AS v))", "artist": "to_json(struct(array(concat('a', c)) AS v))", "venue": "to_json(struct(concat('v', c % 100) AS v))", "eventDate": "to_json(struct(day AS v))", "openTime": "to_json(struct('17:30' AS v))", "startTime": "to_json(struct('18:30' AS v))", "prices": "to_json(struct(array(total, total + 500) AS v))"}


def candidates(spark, d):
    """Nine in ten orders have fields; k % 13 = 1 has an unapproved price, k % 13 = 2 no published price, k % 19 = 3 no approved venue."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_set(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag")))).alias("lines"))
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c", "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "CAST(floor(o_totalprice) AS BIGINT) AS total", "o_orderstatus AS st").join(lines, "k", "left")
    field = lambda name, value: f"struct('{name}' AS key, named_struct('availability_status', CASE WHEN k % 13 = 2 AND '{name}' = 'prices' THEN 'not_found_on_page' ELSE 'published' END, 'confidence', 1.0D, 'approval_state', CASE WHEN k % 13 = 1 AND '{name}' = 'prices' OR k % 19 = 3 AND '{name}' = 'venue' THEN 'pending_review' ELSE 'approved' END, 'approval_hash', concat('{name}', k), 'verified_at', 't', 'value', substring({value}, 6, length({value}) - 6), 'evidence', CAST(array() AS {assembly.EVIDENCE})) AS value)"
    fields = "map_from_entries(array(" + ", ".join(field(n, v) for n, v in _VALUES.items()) + "))"
    df = rows.selectExpr(
        "CAST(k AS STRING) AS id", "CASE WHEN k % 29 = 4 THEN 'candidate' ELSE 'approved' END AS review_state", "k % 31 <> 5 AS ready_for_review", "k % 37 <> 6 AS required_fields_approved", "concat('hash ', k) AS evidence_hash",
        "array(named_struct('source_name', 'hall', 'source_type', CASE WHEN k % 41 = 7 THEN 'blog' ELSE 'venue_official' END, 'source_url', 'https://x.example/', 'fetched_at', 't'), named_struct('source_name', 'fans', 'source_type', 'blog', 'source_url', 'https://y.example/', 'fetched_at', 't')) AS sources",
        "concat('found ', k) AS title", "array(concat('a', c)) AS artist_ids", "array(CASE WHEN k % 9 = 1 THEN 'Rock FES' ELSE 'x' END) AS artist_names", "concat('v', c % 100) AS venue_id", "day AS date", "CASE WHEN k % 43 <> 8 THEN '17:00' END AS open_time", "'18:00' AS start_time",
        f"CAST(transform(filter(coalesce(lines, array()), x -> k % 3 = 0 AND x.flag <> 'N'), x -> named_struct('name', CASE WHEN x.flag = 'A' THEN concat('type ', x.n) ELSE '' END, 'price_jpy', CAST(x.n * 1000 AS BIGINT), 'tax_included', true, 'notes', CASE WHEN x.n > 3 THEN array('late', 'seat') ELSE array() END)) AS {assembly.TICKETS}) AS ticket_types",
        "array(total) AS prices_jpy", f"CAST(array() AS {assembly.FEES}) AS additional_fees", f"CAST(array() AS {assembly.RULES}) AS eligibility", "array('https://t.example/1', 'https://t.example/2') AS ticket_urls",
        f"CAST(transform(coalesce(lines, array()), x -> named_struct('name', x.flag, 'kind', CASE x.flag WHEN 'A' THEN 'fc_lottery' WHEN 'N' THEN 'general' ELSE 'resale' END, 'start', CASE WHEN x.n < 3 THEN '1998-01-01' ELSE '1998-06-01' END, 'end', CASE WHEN x.n = 1 THEN '1998-05-31' ELSE '1998-12-31' END, 'url', concat('https://t.example/', x.n))) AS {assembly.PHASES}) AS ticket_phases",
        "CASE WHEN st = 'P' THEN 'sold_out' END AS status_hint", f"CASE WHEN k % 10 <> 9 THEN {fields} END AS fields",
    )
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], assembly.CANDIDATE).schema.fields])


_CTES = f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(floor(o_totalprice) AS BIGINT) AS total, o_orderstatus AS st, o_orderkey % 10 <> 9 AS f FROM orders), l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_returnflag AS flag FROM lineitem),
p AS (SELECT k, bool_or(n > 1 AND flag = 'R') AS resale, bool_or(n > 1 AND flag = 'A') AS lottery, bool_or(n > 1 AND flag = 'N') AS general, bool_or(n = 1) AS one, bool_or(n = 2) AS two FROM l GROUP BY 1),
t AS (SELECT k, string_agg(CASE WHEN flag = 'A' THEN 'type ' || n ELSE '{assembly.PRICE_LABEL} ' || i END || '=' || n * 1000 || CASE WHEN n > 3 THEN ' late · seat' ELSE '' END, ', ' ORDER BY i) AS tiers FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, flag) AS i FROM l WHERE k % 3 = 0 AND flag <> 'N') GROUP BY 1),
r AS (SELECT *, CASE WHEN k % 29 = 4 OR k % 31 = 5 OR (f AND k % 37 = 6) OR (NOT f AND k % 43 = 8) THEN '{assembly.NOT_READY}' WHEN k % 41 = 7 THEN '{assembly.UNTRACED}' WHEN f AND k % 19 = 3 THEN '{assembly.UNAPPROVED}' END AS refused FROM o)"""


@query(f"""{_CTES} SELECT '' || r.k AS id, refused, CASE WHEN f THEN 'approved ' || r.k ELSE 'found ' || r.k END AS title, CASE WHEN f AND r.k % 19 = 3 THEN NULL ELSE 'v' || c % 100 END AS venue_id, CASE WHEN f THEN '17:30' WHEN r.k % 43 <> 8 THEN '17:00' END AS open_time, CASE WHEN r.k % 9 = 1 THEN 'fes' ELSE 'oneman' END AS type, CASE WHEN day < '{TODAY}' THEN 'completed' ELSE 'scheduled' END AS event_status,
CASE WHEN day < '{TODAY}' THEN 'ended' WHEN st = 'P' THEN 'sold_out' WHEN resale THEN 'resale' WHEN lottery THEN 'lottery' WHEN general THEN 'on_sale' ELSE 'announced' END AS status,
CASE WHEN tiers IS NOT NULL THEN tiers WHEN NOT f THEN '{assembly.PRICE_LABEL}=' || total WHEN r.k % 13 IN (1, 2) THEN '' ELSE '{assembly.PRICE_LABEL} 1=' || total || ', {assembly.PRICE_LABEL} 2=' || (total + 500) END AS tiers,
CASE WHEN coalesce(one, FALSE) THEN '{assembly.SALE_LABEL}' ELSE '{assembly.PAGE_LABEL}' END || ', ' || CASE WHEN coalesce(two, FALSE) THEN '{assembly.SALE_LABEL}' ELSE '{assembly.PAGE_LABEL}' END AS labels,
CASE WHEN f THEN sha256(array_to_string(list_sort(list_filter(['title' || r.k, 'artist' || r.k, CASE WHEN r.k % 19 <> 3 THEN 'venue' || r.k END, 'eventDate' || r.k, 'openTime' || r.k, 'startTime' || r.k, CASE WHEN r.k % 13 <> 1 THEN 'prices' || r.k END], lambda x: x IS NOT NULL)), '|')) ELSE 'hash ' || r.k END AS evidence_hash, CASE WHEN r.k % 41 = 7 THEN '' ELSE 'hall' END AS sources
FROM r LEFT JOIN p ON p.k = r.k LEFT JOIN t ON t.k = r.k""")
def assembled_events(spark, d):
    """Every candidate as the event it makes, with what speaks against publishing it."""
    out = assembly.assembled(candidates(spark, d), NOW, TODAY)
    tier = lambda t: F.concat_ws(" ", F.concat(t["name"], F.lit("="), t["price_jpy"].cast("string")), t["note"])
    return out.select("id", "refused", F.col("title_ja").alias("title"), "venue_id", "open_time", "type", "event_status", "status", F.array_join(F.transform("tiers", tier), ", ").alias("tiers"), F.array_join("ticket_links.label", ", ").alias("labels"), "verification.evidence_hash", F.array_join("verification.sources.name", ", ").alias("sources"))


@query(f"{_CTES} SELECT CASE WHEN day < '{TODAY}' THEN 'completed' ELSE 'scheduled' END AS event_status, count(*) AS n FROM r WHERE refused IS NULL GROUP BY 1")
def published_events(spark, d):
    """Events of the candidates that may be published; publishing would refuse all if one of the others were among them."""
    own = written(candidates(spark, d), "candidates")
    fit = assembly.assembled(own, NOW, TODAY).filter("refused is null").select("id")
    return assembly.publish(written(own.join(fit, "id", "left_semi"), "fit"), NOW, TODAY).groupBy("event_status").agg(F.count("*").alias("n"))


@query(f"""WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0)
SELECT '' || k AS id, CASE WHEN k % 31 = 5 OR k % 10 = 9 THEN '{assembly.NO_CANDIDATE}' WHEN k % 5 = 1 OR k % 11 = 1 OR k % 43 = 8 THEN '{assembly.OTHER_IDENTITY}' || concat_ws(',', CASE WHEN k % 5 = 1 THEN 'title_ja' END, CASE WHEN k % 11 = 1 THEN 'date' END, CASE WHEN k % 43 = 8 THEN 'open_time' END) END AS reason, CASE WHEN k % 10 <> 9 THEN 7 END AS n_fields FROM o""")
def review_migration(spark, d):
    """Which published events' reviews can be taken over, and which have another identity than their candidate."""
    own = candidates(spark, d)
    k = F.col("id").cast("long")
    published = own.filter(k % 7 != 0).select("id", F.when(k % 5 == 1, "renamed").otherwise(F.col("title")).alias("title_ja"), F.reverse("artist_ids").alias("artist_ids"), "venue_id", F.when(k % 11 == 1, "2100-01-01").otherwise(F.col("date")).alias("date"), F.when(k % 43 == 8, "x").otherwise(F.col("open_time")).alias("open_time"), "start_time")
    return assembly.migration(published, own).select("id", "reason", F.when(F.size("fields") >= 0, F.size("fields")).alias("n_fields"))
