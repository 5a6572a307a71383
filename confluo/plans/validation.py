"""What is checked before use: trips, leads, offers, names, paths, decisions of reviewers."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo.functions import checks
from confluo.operators import ranking, review, trips
from confluo.plans.catalogue import query, table
from confluo.plans.reads import TODAY, day, now, today


@query("""WITH s AS (SELECT o_orderkey, strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS due_day, epoch(o_orderdate + INTERVAL 7 DAY + INTERVAL 899 MINUTE) - epoch(TIMESTAMP '1998-07-01') AS s FROM orders)
SELECT o_orderkey, due_day, CASE WHEN s < 0 THEN '已截止' WHEN s < 86400 THEN '今天截止' WHEN s < 172800 THEN '明天截止' ELSE '还剩 ' || CAST(CAST(floor(s / 86400) AS BIGINT) AS VARCHAR) || ' 天' END AS label FROM s""")
def countdown_labels(spark, d):
    """Days left until the end of a day in Japan (14:59 UTC)."""
    due = checks.add_days(F.col("o_orderdate"), 7)
    return table(spark, d, "orders").select("o_orderkey", due.alias("due_day"), checks.days_left_label(due, F.lit(TODAY).cast("timestamp")).alias("label"))


NAME = "p_name || CASE p_size % 6 WHEN 0 THEN ' HALL' WHEN 1 THEN ' (a' WHEN 2 THEN '  guitar' WHEN 3 THEN ' w' WHEN 4 THEN ' guest: x' ELSE '' END"


@query(f"""WITH n AS (SELECT p_partkey, trim(regexp_replace({NAME}, '\\s+', ' ', 'g')) AS name FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(name, '{checks.NOT_AN_ACT}', 'i') OR name LIKE '%(%' OR length(name) > 40 THEN NULL ELSE name END AS act, '#' || substr(sha256(name), 1, 6) AS colour,
CASE WHEN p_partkey % 11 = 0 THEN 'missing_official_source' WHEN p_partkey % 7 = 0 THEN 'missing_raw_evidence' WHEN name LIKE '% w' THEN 'truncated_with_annotation' WHEN name LIKE '% HALL' OR name LIKE '% guest:%' THEN 'role_or_venue_text_mixed_into_name' END AS rejection FROM n""")
def act_names(spark, d):
    n = table(spark, d, "part").withColumn("name", F.trim(F.regexp_replace(F.expr(NAME), r"\s+", " ")))
    rejection = checks.act_rejection(F.col("name"), F.col("p_partkey") % 11, F.col("p_partkey") % 7)
    return n.select("p_partkey", checks.act_name(F.expr(NAME)).alias("act"), checks.colour(F.col("name")).alias("colour"), rejection.alias("rejection"))


@query("""SELECT page_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS segment, kind FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s, CASE page_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'html' WHEN 2 THEN 'xml' ELSE 'bin' END AS kind FROM pages)""")
def path_segments(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("application/JSON", "application/xhtml+xml", "text/xml", "image/png")]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", checks.path_segment(F.col("url")).alias("segment"), checks.file_kind(kind).alias("kind"))


@query("""SELECT event_id, value > 50 AND user_id % 3 <> 0 AS verified, value > 50 AND user_id % 3 <> 0 AND event_type = 'purchase' AS valid FROM events""")
def verified_offers(spark, d):
    level, at = F.when(F.col("value") > 50, "confirmed").otherwise("likely"), F.when(F.col("user_id") % 3 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    kind = F.when(F.col("event_type") == "purchase", "event_detail").otherwise("search")
    return table(spark, d, "events").select("event_id", checks.is_verified(level, at).alias("verified"), checks.is_valid(level, at, kind).alias("valid"))


@query("""SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'N') > 0 AS stored, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'N' OR NOT has) AS offers
FROM (SELECT *, bool_or(l_returnflag = 'N') OVER (PARTITION BY l_orderkey) AS has FROM lineitem) GROUP BY 1""")
def offers_or_derived(spark, d):
    """Stored offers, else those derived from the rest."""
    line, own = F.col("l_linenumber"), F.col("l_returnflag") == "N"
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.when(own, line))).alias("offers"), F.sort_array(F.collect_list(F.when(~own, line))).alias("rest"))
    chosen = F.transform(trips.either(F.col("offers"), F.col("rest")), lambda x: x.cast("string"))
    return rows.select("l_orderkey", (F.size("offers") > 0).alias("stored"), F.array_join(chosen, ",").alias("offers"))


@query("""WITH p AS (SELECT l_orderkey, 'https://eplus.jp/sf/detail/' || l_suppkey AS url, l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS s FROM lineitem WHERE l_linenumber <= 3), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, url ORDER BY CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, s) AS n FROM p),
l AS (SELECT DISTINCT l_orderkey, 'https://eplus.jp/sf/detail/' || l_suppkey AS url FROM lineitem WHERE l_linenumber > 3)
SELECT l_orderkey AS event_id, url, 'eplus' AS provider, CASE l_returnflag WHEN 'N' THEN 'open' WHEN 'A' THEN 'not_started' WHEN 'R' THEN 'closed' END AS sale_status, s || 'T00:00:00+09:00' AS start_at FROM r WHERE n = 1
UNION ALL SELECT l_orderkey, url, 'eplus', 'unknown', NULL FROM l WHERE (l_orderkey, url) NOT IN (SELECT (l_orderkey, url) FROM p)""")
def offers_of_phases(spark, d):
    """One offer for each address: the phase that counts, or none where only a link names it."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.concat(F.lit("https://eplus.jp/sf/detail/"), F.col("l_suppkey").cast("string"), F.lit("?utm_source=a")).alias("url"), "l_linenumber", "l_returnflag", "l_shipdate")
    status = F.when(F.col("l_returnflag") == "N", "open").when(F.col("l_returnflag") == "A", "upcoming").otherwise("closed")
    phases = lines.filter("l_linenumber <= 3").select("event_id", "url", F.lit("general").alias("kind"), status.alias("status"), day("l_shipdate").alias("start"), day("l_shipdate").alias("end"))
    return trips.offers_of_phases(phases, lines.filter("l_linenumber > 3")).select("event_id", "url", "provider", "sale_status", "start_at")


@query("""SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS checked_at FROM orders""")
def order_summaries(spark, d):
    """Evidence stays behind: a nested column is rebuilt from two of its fields, so the scan reads no other."""
    rows = table(spark, d, "orders").withColumn("verification", F.struct(day("o_orderdate").alias("checked_at"), F.col("o_totalprice").alias("evidence")))
    return rows.withColumn("verification", F.col("verification").dropFields("evidence")).select("o_orderkey", "o_orderstatus", "verification.checked_at")


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN '票价已由官方来源公开。' WHEN 'view' THEN '当前官方来源不提供票价，请进入来源页确认后续更新。' WHEN 'error' THEN '票价解析失败，已进入修复队列；这不代表官方尚未公布。' ELSE '票价仍在确认中，确认前不会展示。' END AS message, ts < TIMESTAMP '2024-01-16' - INTERVAL 10 DAY AS warned FROM events""")
def availability_messages(spark, d):
    kind = F.col("event_type")
    found = F.when(kind == "purchase", "published").when(kind == "view", "source_does_not_disclose").when(kind == "error", "parser_failed").otherwise("pending_review")
    return table(spark, d, "events").select("event_id", checks.availability_message(found, F.lit("票价")).alias("message"), (F.col("ts") < now() - F.expr("INTERVAL 10 DAYS")).alias("warned"))


@query("""SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS spent, count(*) FILTER (WHERE l_linestatus = 'F') AS ticked FROM lineitem GROUP BY 1""")
def trip_budgets(spark, d):
    """Totals over the nested entries of a trip."""
    entries = F.collect_list(F.struct(F.col("l_quantity").cast("long").alias("amount"), (F.col("l_linestatus") == "F").alias("done"))).alias("entries")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(entries).select("l_orderkey", trips.spent(F.col("entries")).alias("spent"), trips.ticked(F.col("entries")).alias("ticked"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS start_day FROM orders WHERE o_orderdate + INTERVAL 5 DAY >= TIMESTAMP '1998-07-01' ORDER BY o_orderdate, o_orderkey LIMIT 3""")
def next_trips(spark, d):
    """The three trips that come first, of those that have not ended."""
    rows = table(spark, d, "orders").filter(F.col("o_orderdate") >= F.date_sub(today(), 5).cast("timestamp"))
    return ranking.top(rows, [F.col("o_orderdate"), F.col("o_orderkey")], 3).select("o_orderkey", day("o_orderdate").alias("start_day"))


@query("""WITH u AS (SELECT o_orderkey, o_orderdate, c_nationkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1998-07-01'), f AS (SELECT 'followed' AS strip, * FROM u WHERE o_custkey % 10 = 3 ORDER BY o_orderdate, o_orderkey LIMIT 10), n AS (SELECT 'nearby' AS strip, * FROM u WHERE c_nationkey = 4 ORDER BY o_orderdate, o_orderkey LIMIT 10)
SELECT strip, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM (SELECT * FROM f UNION ALL SELECT * FROM n)""")
def home_strips(spark, d):
    """Two top-k lists: of followed customers, and of a nation. Both sort no more than ten rows a partition."""
    coming = table(spark, d, "orders").filter(F.col("o_orderdate") >= today())
    near = coming.join(table(spark, d, "customer").filter("c_nationkey = 4").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    first = lambda df, name: ranking.top(df, [F.col("o_orderdate"), F.col("o_orderkey")], 10).select(F.lit(name).alias("strip"), "o_orderkey", day("o_orderdate").alias("order_day"))
    return first(coming.filter("o_custkey % 10 = 3"), "followed").unionByName(first(near, "nearby"))


@query("""WITH e AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_quantity >= 10) AS budget, count(*) FILTER (WHERE l_linestatus = 'F') AS checks, count(*) FILTER (WHERE l_linenumber <= 3) AS custom, count(DISTINCT l_partkey) AS events, max(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS end_day, CAST(CASE WHEN q < 30 THEN 90 ELSE least(720, CAST(q AS INTEGER) * 20) END AS INTEGER) AS buffer, budget, checks, custom, events FROM orders JOIN e ON l_orderkey = o_orderkey WHERE o_orderpriority <> '1-URGENT'""")
def normalised_trips(spark, d):
    """Trips made of orders and their lines, with entries that are dropped one by one."""
    text, line = lambda c: F.col(c).cast("string"), F.col("l_linenumber").cast("string")
    budget = F.struct(line.alias("id"), F.when(F.col("l_returnflag") != "R", "hotel").otherwise("fuel").alias("kind"), F.lit("x").alias("label"), (F.col("l_quantity") - 10).cast("int").alias("amount"))
    check = F.struct(line.alias("id"), F.when(F.col("l_linestatus") == "F", " y ").otherwise(" ").alias("label"), F.lit(True).alias("done"), F.lit("manual").alias("source"))
    own = F.struct(line.alias("id"), F.lit("1998-02-28").alias("date"), F.when(F.col("l_linenumber") <= 3, "09:30").otherwise("24:00").alias("time"), F.lit("z").alias("label"), F.lit("todo").alias("kind"))
    leg = F.struct(line.alias("id"), F.lit("bus").alias("type"), F.lit("a").alias("from"), F.lit("b").alias("to"), F.lit(None).cast("string").alias("depart"), F.lit(None).cast("string").alias("arrive"), F.lit("confirmed").alias("status"), F.lit(5).alias("minutes"), F.lit(None).cast("string").alias("reference"))
    lists = {"budget": budget, "checklist": check, "custom": own, "legs": leg, "event_ids": F.col("l_partkey").cast("string")}
    nested = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[F.collect_list(c).alias(n) for n, c in lists.items()], F.max("l_quantity").alias("q"))
    rows = table(spark, d, "orders").join(nested, "o_orderkey")
    name = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).otherwise("  ")
    rows = rows.withColumns({"id": text("o_orderkey"), "name": name, "start": day("o_orderdate"), "end": day(F.date_sub("o_orderdate", 2)), "buffer": F.when(F.col("q") >= 30, F.col("q").cast("int") * 20)})
    count = lambda c: F.size(c).cast("long")
    return trips.normalised(rows).select("id", F.col("end").alias("end_day"), "buffer", count("budget").alias("budget"), count("checklist").alias("checks"), count("custom").alias("custom"), count("event_ids").alias("events"))


@query("""SELECT CAST(event_id AS VARCHAR) AS id, CASE event_type WHEN 'purchase' THEN 'matched' WHEN 'view' THEN 'dismissed' ELSE 'inbox' END AS status FROM events WHERE (event_type <> 'purchase' OR user_id % 2 = 0) AND (value > 20 OR user_id % 5 = 0) AND user_id % 7 <> 0""")
def normalised_leads(spark, d):
    kind, user = F.col("event_type"), F.col("user_id")
    url = F.when(user % 7 == 0, "https://me@x.com/a").when(F.col("value") > 20, "https://x.com/a?token=1")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), url.alias("url"), F.when(user % 5 == 0, "seen").otherwise(" ").alias("pasted"), F.when(kind == "purchase", "matched").when(kind == "view", "dismissed").otherwise("new").alias("status"), F.when(user % 2 == 0, "e").alias("event_id"))
    return trips.leads(rows).select("id", "status")


@query("""WITH c AS (SELECT o_orderkey, o_orderstatus = 'P' AS rejected, o_orderstatus = 'F' AND o_custkey % 4 <> 0 AS approved, o_orderkey % 5 AS m, o_orderpriority = '1-URGENT' AS dateless, o_orderpriority = '2-HIGH' AS untitled FROM orders),
s AS (SELECT *, approved AND NOT rejected AND m > 1 AND NOT dateless AS ok FROM c)
SELECT o_orderkey, NOT dateless AS ready, CASE WHEN rejected THEN 'rejected' WHEN ok THEN 'approved' ELSE 'candidate' END AS state,
CASE WHEN dateless THEN 'missing_date' WHEN untitled THEN 'required_field:title:published:pending' WHEN ok THEN NULL WHEN rejected THEN 'rejected' ELSE 'field_review_pending' END AS primary_reason,
concat_ws(',', CASE WHEN dateless THEN 'missing_date' ELSE 'odd' END, CASE WHEN NOT approved OR rejected THEN NULL WHEN m = 0 THEN 'approval_requires_evidence_hash' WHEN m = 1 THEN 'approval_stale' WHEN dateless THEN 'approval_blocked' END,
CASE WHEN ok OR dateless THEN NULL WHEN untitled THEN 'required_field:title:published:pending' WHEN rejected THEN 'rejected' ELSE 'field_review_pending' END) AS issues FROM s""")
def review_states(spark, d):
    """Decisions on candidates made of orders: stale and blocked approvals fall back."""
    urgent, m = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") % 5
    title = F.struct(F.lit("title").alias("name"), F.lit("published").alias("availability"), F.when(F.col("o_orderpriority") == "2-HIGH", "pending").otherwise("approved").alias("approval"))
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.array(F.when(urgent, "missing_date").otherwise("odd")).alias("issues"), F.array(title).alias("fields"), F.lit("h").alias("evidence_hash"), (F.col("o_orderstatus") == "P").alias("rejected"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 4 != 0)).alias("approved"), F.when(m == 1, "old").when(m > 1, "h").alias("approved_hash"),
    )
    return review.decide(rows).select("o_orderkey", "ready", "state", "primary_reason", F.array_join("issues", ",").alias("issues"))


@query("""WITH o AS (SELECT l_orderkey AS event_id, 'f' || l_linenumber AS field, min(CAST(l_partkey AS VARCHAR)) AS hash FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), n AS (SELECT l_orderkey AS event_id, 'f' || l_linenumber AS field, min(CAST(l_suppkey AS VARCHAR)) AS hash FROM lineitem WHERE l_returnflag <> 'A' OR l_linenumber = 2 GROUP BY 1, 2),
r AS (SELECT o.event_id, o.field, o.hash FROM o ANTI JOIN n ON o.event_id = n.event_id AND o.field = n.field UNION ALL SELECT * FROM n)
SELECT event_id, field, hash, CASE WHEN event_id IN (SELECT event_id FROM n) THEN 'new' ELSE 'old' END AS reviewer FROM r""")
def ledger_after_review(spark, d):
    """Approvals of fields, taken over from a batch into the ledger."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.concat(F.lit("f"), "l_linenumber").alias("field"), "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey")
    fields = lambda df, c: df.groupBy("event_id", "field").agg(F.min(F.col(c).cast("string")).alias("hash")).groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "hash"))).alias("fields"))
    old = fields(lines.filter("l_returnflag = 'A'"), "l_partkey").withColumns({"reviewer": F.lit("old"), "verified_at": F.lit(TODAY).cast("timestamp")})
    new = fields(lines.filter("l_returnflag <> 'A' or l_linenumber = 2"), "l_suppkey")
    return review.take_over(old, new, "new", now()).select("event_id", F.explode("fields").alias("field", "hash"), "reviewer")
