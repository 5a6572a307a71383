"""Queries over records as sources give them: JSON, linked data, exports and backups, queues, ranks and deadlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo.functions import clock, status, urls
from confluo.operators import control, ranking, reports, schedule
from confluo.plans.catalogue import query, table
from confluo.sources import html, records


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, 'base' AS origin FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, 'ingested' FROM supplier")
def records_of_json(spark, d):
    """A base table and records that come as JSON, as one."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit("base").alias("origin"))
    raw = table(spark, d, "supplier").select(F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))).alias("body"))
    return base.unionByName(raw.select(F.from_json("body", "id long, name string, nation int").alias("r")).select("r.*", F.lit("ingested").alias("origin")))


@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN 'order ' || o_orderkey END AS title, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 7 <> 0 THEN 'place ' || o_custkey END AS venue, CAST(o_orderkey % 1000 AS BIGINT) AS a, CAST(o_orderkey % 1000 + o_orderkey % 2 * 500 AS BIGINT) AS b FROM orders)
SELECT 'e' || k AS source_event_id, title, day AS date, '18:30' AS start_time, venue AS venue_name, CASE WHEN a = b THEN '' || a ELSE a || ',' || b END AS prices FROM o WHERE title IS NOT NULL AND venue IS NOT NULL""")
def api_event_rows(spark, d):
    """Pages of an events API, a row an event; without title, date or venue dropped."""
    low = (F.col("o_orderkey") % 1000).cast("double")
    price = lambda currency, a, b: F.struct(F.lit(currency).alias("currency"), a.alias("min"), b.alias("max"))
    event = F.struct(
        F.concat(F.lit("e"), "o_orderkey").alias("id"), F.when(F.expr("o_orderkey % 5 <> 0"), F.concat(F.lit("order "), "o_orderkey")).alias("name"), F.struct(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("localDate"), F.lit("18:30:00").alias("localTime")).alias("start")).alias("dates"),
        F.array(price("USD", low, low), price("JPY", low, low + F.col("o_orderkey") % 2 * 500)).alias("priceRanges"), F.struct(F.array(F.struct(F.when(F.expr("o_orderkey % 7 <> 0"), F.concat(F.lit("place "), "o_custkey")).alias("name"))).alias("venues")).alias("_embedded"),
    )
    raw = table(spark, d, "orders").select(F.to_json(F.struct(F.struct(F.array(event).alias("events")).alias("_embedded"))).alias("content"))
    return records.api_events(raw).select("source_event_id", "title", "date", "start_time", "venue_name", F.array_join(F.col("prices_jpy").cast("array<string>"), ",").alias("prices"))


@query("""WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['17:00'] ELSE ['12:00', '17:30'] END AS opens, CASE WHEN c_custkey % 4 = 0 THEN ['18:00'] ELSE ['13:00', '18:30'] END AS starts FROM customer), s AS (SELECT c_custkey, opens, unnest(starts) AS start_time, unnest(range(len(starts))) AS n FROM c)
SELECT c_custkey, CAST(n AS INTEGER) AS "show", start_time, coalesce(opens[n + 1], opens[1]) AS open_time FROM s""")
def arena_show_rows(spark, d):
    lists = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    opens = F.when(F.expr("c_custkey % 3 = 0"), lists()).when(F.expr("c_custkey % 3 = 1"), lists("17:00")).otherwise(lists("12:00", "17:30"))
    raw = table(spark, d, "customer").select("c_custkey", opens.alias("opens"), F.when(F.expr("c_custkey % 4 = 0"), lists("18:00")).otherwise(lists("13:00", "18:30")).alias("starts"))
    return records.arena_shows(raw).select("c_custkey", "show", "start_time", "open_time")


LINKED = """CASE page_id % 4 WHEN 0 THEN '<script type="application/ld+json">{"@type": broken}</script>' WHEN 1 THEN '<script type="application/ld+json">  [{"@type":"Place","name":"no"},{"@type":["Thing","MusicEvent"],"name":"a  b ' || page_id || '","startDate":"2026-07-0' || (page_id % 9 + 1) || 'T18:30:00+09:00","location":{"name":"hall"},"performer":["x",{"name":"y"},{}],"offers":[{"price":"1200","url":"https://t.jp/' || page_id || '"},{"price":"free"},{"price":800}]}]</script>'
WHEN 2 THEN '<script type="application/ld+json">{"@graph":[{"@type":"Event","name":"g' || page_id || '","startDate":"2026-08-01","location":"text"}]}</script>' ELSE '<script type="text/plain">{"@type":"Event"}</script>' END"""


@query("""SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'a  b ' || page_id WHEN 2 THEN 'g' || page_id END AS title, CASE page_id % 4 WHEN 1 THEN '2026-07-0' || (page_id % 9 + 1) WHEN 2 THEN '2026-08-01' END AS date, CASE WHEN page_id % 4 = 1 THEN '18:30' END AS start_time, CASE WHEN page_id % 4 = 1 THEN 'hall' END AS venue_name, CASE page_id % 4 WHEN 1 THEN 'x,y' ELSE '' END AS artists,
CASE page_id % 4 WHEN 1 THEN '1200.0,800.0' ELSE '' END AS prices, CASE page_id % 4 WHEN 1 THEN 'https://t.jp/' || page_id ELSE '' END AS links, page_id % 4 = 0 AS failed FROM pages WHERE page_id % 4 <> 3""")
def linked_data_events(spark, d):
    return _events(spark, d, LINKED, "json_ld_events")


APP_DATA = """CASE page_id % 4 WHEN 0 THEN '<script id="__NEXT_DATA__">{"props":{"list":[{"title":"t' || page_id || '","date":"2026-07-01","venue":{"name":"v"},"price":500,"url":"https://t.jp/1"},{"name":"t' || page_id || '","eventDate":"2026-07-01T10:00","venueName":"v"}]}}</script>' WHEN 1 THEN '<script type="application/json">{"a":{"name":"n","startDate":"2026-09-09T19:00:00","performer":{"name":"p' || page_id || '"},"prices":["1000","x",2000]}}</script>'
WHEN 2 THEN '<script id="__OTHER__">{"title":"t","date":"2026-01-01","venueName":"v"}</script>' ELSE '<script id="__NUXT_DATA__">{"title":"only","date":"2026-01-01"}</script>' END"""


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 't' || page_id ELSE 'n' END AS title, CASE page_id % 4 WHEN 0 THEN '2026-07-01' ELSE '2026-09-09' END AS date, CASE WHEN page_id % 4 = 1 THEN '19:00' END AS start_time, CASE WHEN page_id % 4 = 0 THEN 'v' END AS venue_name, CASE page_id % 4 WHEN 1 THEN 'p' || page_id ELSE '' END AS artists,
CASE page_id % 4 WHEN 0 THEN '500.0' ELSE '1000.0,2000.0' END AS prices, CASE page_id % 4 WHEN 0 THEN 'https://t.jp/1' ELSE '' END AS links, FALSE AS failed FROM pages WHERE page_id % 4 IN (0, 1)""")
def application_data_events(spark, d):
    return _events(spark, d, APP_DATA, "embedded_events")


def _events(spark, d, made: str, function: str):
    """The events that a table function finds in the pages with the scripts of `made` in them."""
    html.register(spark)
    pages = table(spark, d, "pages").select("page_id", F.concat(F.col("html"), F.expr(made)).alias("html"))
    rows = spark.sql(f"SELECT page_id, e.* FROM {{pages}}, LATERAL {function}(html) AS e", pages=pages)
    joined = lambda c: F.array_join(F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")), ",")
    return rows.select("page_id", "title", "date", "start_time", "venue_name", joined("artist_names").alias("artists"), joined("prices").alias("prices"), joined("purchase_urls").alias("links"), F.col("error").isNotNull().alias("failed"))


@query(r"""SELECT '| ' || p_partkey || ' | ' || replace(p_name || CASE WHEN p_partkey % 3 = 0 THEN '|x' ELSE '' END, '|', '\|') || ' | ' || coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_brand END, '') || ' |' AS line FROM part""")
def markdown_lines(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(F.expr("p_partkey % 3 = 0"), "|x").otherwise("")).alias("name"), F.when(F.expr("p_partkey % 4 <> 0"), F.col("p_brand")).alias("brand"))
    return records.markdown(rows, ["p_partkey", "name", "brand"])


@query("SELECT c_custkey FROM customer WHERE c_custkey % 10 IN (0, 1) OR (c_custkey % 10 = 2 AND c_acctbal IS NOT NULL)")
def stale_export_keys(spark, d):
    """Keys whose exported row is missing, left over or of another content."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    old, new = c.filter("c_custkey % 10 <> 0"), c.filter("c_custkey % 10 <> 1").withColumn("c_acctbal", F.when(F.expr("c_custkey % 10 <> 2"), F.col("c_acctbal")))
    return records.stale_exports(old, new, "c_custkey")


@query("SELECT s_suppkey, s_name, CASE WHEN s_nationkey < 20 THEN 'restored' ELSE 'ignored' END AS state FROM supplier")
def backup_rows(spark, d):
    """A backup read again: rows of known keys are restored."""
    s = table(spark, d, "supplier")
    back, lost = records.from_backup(records.to_backup(s, 5, ["s_suppkey", "s_name"]), "s_suppkey long, s_name string", s.filter("s_nationkey < 20"), "s_suppkey")
    return back.withColumn("state", F.lit("restored")).unionByName(lost.withColumn("state", F.lit("ignored")))


@query("""WITH p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') SELECT 'u' || c_custkey AS url, c_mktsegment AS role, CASE WHEN user_id IS NULL THEN 'pending' ELSE 'done' END AS status, CASE WHEN user_id IS NULL THEN 0 ELSE 3 END AS attempts FROM customer LEFT JOIN p ON user_id = c_custkey""")
def queue_merge(spark, d):
    seed = table(spark, d, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("url"), F.col("c_mktsegment").alias("role"))
    previous = table(spark, d, "events").filter("event_type = 'purchase'").select(F.concat(F.lit("u"), "user_id").alias("url"), F.lit("done").alias("status"), F.lit(3).alias("attempts")).distinct()
    return control.merge_queue(seed, previous)


@query("""WITH e AS (SELECT user_id, CASE event_id % 4 WHEN 0 THEN 'never' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS checked, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'unknown' WHEN 2 THEN NULL ELSE event_type END AS kind FROM events)
SELECT user_id, strftime(coalesce(max(TRY_CAST(checked AS TIMESTAMP)), TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M:%S') AS verified, coalesce(string_agg(DISTINCT CASE WHEN kind NOT IN ('', 'unknown') THEN kind END, ', ' ORDER BY CASE WHEN kind NOT IN ('', 'unknown') THEN kind END), '') AS kinds FROM e GROUP BY 1""")
def latest_and_known(spark, d):
    """Per user the latest valid check, else a fallback, and the known kinds."""
    checked = F.when(F.expr("event_id % 4 = 0"), "never").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    kind = F.when(F.expr("event_id % 5 = 0"), "").when(F.expr("event_id % 5 = 1"), "unknown").when(F.expr("event_id % 5 <> 2"), F.col("event_type"))
    latest = reports.latest_of(checked, F.lit("2000-01-01").cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg(F.date_format(latest, "yyyy-MM-dd HH:mm:ss").alias("verified"), reports.known_joined(kind).alias("kinds"))


KANA = "CASE p_partkey % 6 WHEN 0 THEN 'あ' WHEN 1 THEN 'い' WHEN 2 THEN 'か' WHEN 3 THEN 'さ' WHEN 4 THEN 'な' ELSE 'わ' END || p_name"


@query(f"SELECT p_partkey, {KANA} AS title FROM part ORDER BY title COLLATE ja, p_partkey LIMIT 50")
def japanese_order(spark, d):
    """The first titles by Japanese collation."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(KANA).alias("title"))
    return ranking.top(rows, [ranking.japanese("title"), F.col("p_partkey")], 50)


LOCAL = "CASE o_orderkey % 5 WHEN 0 THEN substr('' || o_orderdate, 1, 10) || 'T23:59' WHEN 1 THEN '2026-02-30T10:00' WHEN 2 THEN substr('' || o_orderdate, 1, 10) || 'T24:00' WHEN 3 THEN substr('' || o_orderdate, 1, 10) ELSE substr('' || o_orderdate, 1, 10) || 'T08:30' END"


@query(rf"""WITH t AS (SELECT o_orderkey, {LOCAL} AS t FROM orders), v AS (SELECT *, regexp_matches(t, '^\d{{4}}-\d{{2}}-\d{{2}}T([01]\d|2[0-3]):[0-5]\d$') AND TRY_CAST(substr(t, 1, 10) AS DATE) IS NOT NULL AS valid FROM t)
SELECT o_orderkey, valid, CASE WHEN valid THEN strftime(CAST(replace(t, 'T', ' ') || ':00' AS TIMESTAMP) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') END AS due_utc FROM v""")
def local_deadlines(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(LOCAL).alias("t"))
    return rows.select("o_orderkey", clock.valid_local(F.col("t")).alias("valid"), F.date_format(clock.deadline_instant(F.col("t")), "yyyy-MM-dd HH:mm").alias("due_utc"))


TYPE = "CASE s_suppkey % 10 WHEN 0 THEN 'artist_official' WHEN 1 THEN 'promoter_official' WHEN 2 THEN 'venue_official' WHEN 3 THEN 'ticket_official' WHEN 4 THEN 'official_api' WHEN 5 THEN 'ticket_api' WHEN 6 THEN 'blog' WHEN 7 THEN 'organizer_site' WHEN 8 THEN 'official_artist' END"


@query(f"""WITH t AS (SELECT s_suppkey, {TYPE} AS t FROM supplier), u AS (SELECT *, coalesce(t, '') AS v FROM t)
SELECT s_suppkey, CASE t WHEN 'artist_official' THEN 1.0::DOUBLE WHEN 'promoter_official' THEN 0.98 WHEN 'venue_official' THEN 0.96 WHEN 'ticket_official' THEN 0.94 WHEN 'official_api' THEN 0.9 WHEN 'ticket_api' THEN 0.9 ELSE 0.7 END AS confidence,
CASE WHEN starts_with(v, 'artist') THEN 'artist' WHEN starts_with(v, 'venue') THEN 'venue' WHEN starts_with(v, 'promoter') OR starts_with(v, 'organizer') THEN 'promoter' WHEN starts_with(v, 'ticket') OR starts_with(v, 'playguide') THEN 'ticket' WHEN contains(v, 'api') THEN 'api' ELSE coalesce(t, 'unknown') END AS family,
CASE WHEN contains(v, 'artist') THEN 'artist' WHEN contains(v, 'venue') THEN 'venue' WHEN contains(v, 'promoter') THEN 'promoter' WHEN contains(v, 'ticket') THEN 'ticket' WHEN contains(v, 'api') THEN 'structured_api' WHEN v = '' THEN 'unknown' ELSE v END AS coverage_family FROM u""")
def source_ranks(spark, d):
    """How sure sources are, and their families as the publishing guard and as the report of coverage count them."""
    kind = F.expr(TYPE)
    return table(spark, d, "supplier").select("s_suppkey", status.source_confidence(kind).cast("double").alias("confidence"), status.source_family(kind).alias("family"), status.coverage_family(kind).alias("coverage_family"))


@query("""WITH f AS (SELECT l_orderkey AS event_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, CASE WHEN l_quantity > 45 THEN 'won' WHEN l_quantity > 40 THEN 'applied' END AS application, CASE l_returnflag WHEN 'A' THEN 'open' WHEN 'N' THEN 'not_started' ELSE 'closed' END AS sale, l_shipdate AS due FROM lineitem),
s AS (SELECT *, CASE WHEN application = 'won' THEN 'pay' WHEN application = 'applied' THEN 'await result' WHEN sale = 'open' THEN 'apply' WHEN sale = 'not_started' THEN 'wait for start' END AS label FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY due NULLS LAST, id, label) AS n FROM s WHERE label IS NOT NULL)
SELECT event_id, label, id AS offer_id, due < TIMESTAMP '1998-07-01' AS overdue FROM r WHERE n = 1""")
def next_steps(spark, d):
    application = F.when(F.col("l_quantity") > 45, "won").when(F.col("l_quantity") > 40, "applied")
    sale = F.when(F.col("l_returnflag") == "A", "open").when(F.col("l_returnflag") == "N", "not_started").otherwise("closed")
    due = {c: F.col("l_shipdate") for c in ("payment_deadline", "result_at", "end_at", "start_at")}
    offers = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), application.alias("application"), sale.alias("sale_status"), *[c.alias(k) for k, c in due.items()])
    return schedule.next_action(offers, F.lit("1998-07-01").cast("timestamp")).select("event_id", "label", "offer_id", "overdue")


@query("SELECT p_partkey, 'https://www.google.com/maps/dir/?api=1&destination=' || replace(url_encode(p_name || ', ' || p_brand), '%20', '+') AS route FROM part")
def route_links(spark, d):
    return table(spark, d, "part").select("p_partkey", urls.maps_route(F.concat_ws(", ", "p_name", "p_brand")).alias("route"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def gated_orders(spark, d):
    """Orders, published only if none breaks a rule."""
    o = table(spark, d, "orders")
    broken = control.violations(o, F.col("o_orderkey"), {"no price": F.col("o_totalprice").isNull(), "no day": F.col("o_orderdate").isNull()})
    return control.gated(o.select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi"), broken).select("o_orderkey", "o_custkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey IN (3, 5, 8)")
def planned_customers(spark, d):
    known = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return control.planned_ids(spark, ["8", "3", "5", "3"], known, "id")


SEED = "'HTTPS://X.jp/' || (l_partkey % 500) || CASE l_linenumber % 3 WHEN 0 THEN '/' WHEN 1 THEN '?utm_source=a' ELSE '#top' END"


@query("""WITH l AS (SELECT DISTINCT 'https://x.jp/' || (l_partkey % 500) AS url, CASE WHEN l_returnflag = 'A' THEN 'ticket_detail' ELSE 'official' END AS role, 'e' || (l_orderkey % 50) AS event_id FROM lineitem WHERE l_linestatus = 'O')
SELECT url, CASE WHEN bool_or(role = 'ticket_detail') THEN 'ticket_detail' ELSE 'official' END AS role, string_agg(DISTINCT event_id, ',' ORDER BY event_id) AS event_ids, 'pending' AS status FROM l GROUP BY 1""")
def frontier_seed(spark, d):
    """A job for each canonical link that is not checked, with the events that name it."""
    links = table(spark, d, "lineitem").select(F.concat(F.lit("e"), F.col("l_orderkey") % 50).alias("event_id"), F.expr(SEED).alias("url"), F.when(F.col("l_returnflag") == "A", "ticket_detail").otherwise("official").alias("role"), (F.col("l_linestatus") != "O").alias("checked"))
    return control.seed_jobs(links).withColumn("event_ids", F.array_join("event_ids", ","))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 25 THEN l_returnflag END AS flag, CASE WHEN l_quantity > 25 THEN l_discount END AS discount FROM lineitem")
def facts_of_details(spark, d):
    """Facts stay only with links that are pages of one event."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("discount"), F.when(F.col("l_quantity") > 25, "event_detail").otherwise("search").alias("url_kind"))
    return control.without_facts(rows, ["flag", "discount"]).drop("url_kind")
