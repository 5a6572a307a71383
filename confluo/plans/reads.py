"""Read queries: filters, lookups, rankings, recommendations, calendars, schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from confluo.functions import clock, status, text, urls
from confluo.operators import facets, pairs, ranking, reports
from confluo.plans.catalogue import query, table

#: The day that orders are looked at, and the moment for events.
TODAY, NOW = "1998-07-01", "2024-01-16 00:00:00"


def today():
    return F.lit(TODAY).cast("date")


def now():
    return F.lit(NOW).cast("timestamp")


def with_place(spark, d):
    """Orders with customer, nation and region: small dimensions are left to the optimiser's size check."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query("""SELECT o_orderkey, c_name, n_name, r_name, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderstatus IN ('O', 'P') AND o_orderdate BETWEEN TIMESTAMP '1998-07-01' AND TIMESTAMP '1998-12-31' ORDER BY o_totalprice, o_orderdate, o_orderkey LIMIT 120""")
def facet_filter_orders(spark, d):
    wanted = facets.Facets(equal={"r_name": "ASIA"}, among={"o_orderstatus": ("O", "P")})
    rows = facets.apply(with_place(spark, d), wanted).filter(F.col("o_orderdate").between(F.lit(TODAY).cast("timestamp"), F.lit("1998-12-31").cast("timestamp")))
    return ranking.top(rows, [F.col("o_totalprice"), F.col("o_orderdate"), F.col("o_orderkey")], 120).select("o_orderkey", "c_name", "n_name", "r_name", "o_totalprice", day("o_orderdate").alias("order_day"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')")
def text_search_parts(spark, d):
    return facets.apply(table(spark, d, "part"), facets.Facets(text="RING", text_columns=("p_name", "p_brand", "p_type"))).select("p_partkey", "p_name", "p_brand")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def lookup_left_join(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer").filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT CAST(pos AS INTEGER) AS pos, p_partkey, p_name FROM (VALUES (0, 7), (1, 3), (2, 999999), (3, 11)) AS v(pos, id) JOIN part ON p_partkey = id")
def ordered_slice(spark, d):
    ids = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in (7, 3, 999999, 11)])).alias("pos", "id"))
    return ids.join(table(spark, d, "part"), F.col("id") == F.col("p_partkey")).select("pos", "p_partkey", "p_name")


@query("""SELECT o_orderkey, min(l_extendedprice) AS min_price, round(coalesce(min(l_extendedprice), o_totalprice, 0), 2) AS budget FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'R' GROUP BY o_orderkey, o_totalprice""")
def min_price_per_order(spark, d):
    least = table(spark, d, "lineitem").filter("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_extendedprice").alias("min_price"))
    return table(spark, d, "orders").join(least, "o_orderkey", "left").select("o_orderkey", "min_price", F.round(F.coalesce("min_price", "o_totalprice", F.lit(0)), 2).alias("budget"))


@query("""WITH f AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS resale, bool_or(l_linestatus = 'O' AND l_shipdate > TIMESTAMP '1998-07-01') AS lottery, bool_or(l_linestatus = 'O' AND l_shipdate <= TIMESTAMP '1998-07-01') AS on_sale FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-07-01' THEN 'ended' WHEN o_orderstatus = 'F' THEN 'sold_out' WHEN resale THEN 'resale' WHEN lottery THEN 'lottery' WHEN on_sale THEN 'on_sale' ELSE 'announced' END AS display_status FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def order_display_status(spark, d):
    open_line, later = F.col("l_linestatus") == "O", F.col("l_shipdate") > today()
    flags = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("resale"), F.bool_or(open_line & later).alias("lottery"), F.bool_or(open_line & ~later).alias("on_sale"))
    ended, sold = F.col("o_orderdate") < today(), F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").join(flags, "o_orderkey", "left").select("o_orderkey", status.display_status(ended, sold, F.col("resale"), F.col("lottery"), F.col("on_sale")).alias("display_status"))


@query("""WITH s AS (SELECT CASE l_returnflag WHEN 'R' THEN 'closed' ELSE 'unknown' END AS st, CASE WHEN l_linestatus = 'O' THEN l_shipdate END AS a, CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL 30 DAY END AS b FROM lineitem)
SELECT CASE WHEN b < TIMESTAMP '1998-07-01' THEN 'closed' WHEN st = 'closed' THEN 'closed' WHEN a > TIMESTAMP '1998-07-01' THEN 'not_started' WHEN a <= TIMESTAMP '1998-07-01' THEN 'open' ELSE st END AS sale_status, count(*) AS n FROM s GROUP BY 1""")
def offer_sale_status(spark, d):
    start, end = F.when(F.col("l_linestatus") == "O", F.col("l_shipdate")), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS"))
    at = F.lit(TODAY).cast("timestamp")
    return table(spark, d, "lineitem").groupBy(status.sale_status(F.when(F.col("l_returnflag") == "R", "closed").otherwise("unknown"), start, end, at).alias("sale_status")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN ts IS NULL OR TIMESTAMP '2024-02-05' - ts > INTERVAL 30 DAY THEN 'unknown' ELSE event_type END AS status FROM events""")
def stale_neutralised(spark, d):
    stale = status.is_stale(F.col("ts"), F.lit("2024-02-05").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.when(stale, "unknown").otherwise(F.col("event_type")).alias("status"))


@query("""SELECT CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'high' WHEN l_shipdate BETWEEN TIMESTAMP '1998-07-01' AND TIMESTAMP '1998-07-08' THEN 'high' WHEN l_returnflag IN ('N', 'R') THEN 'medium' ELSE 'low' END AS priority, count(*) AS n FROM lineitem GROUP BY 1""")
def refresh_priority(spark, d):
    state = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), "open").when(F.col("l_returnflag") == "N", "not_started").when(F.col("l_returnflag") == "R", "unknown").otherwise("closed")
    return table(spark, d, "lineitem").groupBy(status.refresh_priority(state, F.col("l_shipdate"), F.lit(TODAY).cast("timestamp")).alias("priority")).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1998-07-01' GROUP BY 1)
SELECT n_nationkey, n_name, coalesce(n, 0) AS heat, round(coalesce(n, 0) / greatest(1, max(coalesce(n, 0)) OVER ()), 6) AS share FROM nation LEFT JOIN h ON c_nationkey = n_nationkey""")
def nation_heat(spark, d):
    """Counts per nation, zeros kept. The window runs over the rows of `nation` alone."""
    facts = table(spark, d, "orders").filter(F.col("o_orderdate") >= today()).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    heat = reports.zero_filled(table(spark, d, "nation"), "n_nationkey", facts, "c_nationkey").withColumnRenamed("n", "heat")
    return heat.select("n_nationkey", "n_name", "heat", F.round(F.col("heat") / F.greatest(F.lit(1), F.max("heat").over(Window.partitionBy())), 6).alias("share"))


@query("""SELECT c_custkey, c_name, count(*) AS heat, row_number() OVER (ORDER BY count(*) DESC, c_custkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' GROUP BY 1, 2 ORDER BY heat DESC, c_custkey LIMIT 20""")
def customer_heat_topk(spark, d):
    heat = table(spark, d, "orders").filter("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("heat")).join(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")
    return ranking.ranks_of_top(heat, [F.col("heat").desc(), F.col("c_custkey")], 20).select("c_custkey", "c_name", "heat", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' ORDER BY o_orderdate, o_orderkey LIMIT 10")
def upcoming_topk(spark, d):
    return ranking.top(table(spark, d, "orders").filter(F.col("o_orderdate") >= today()), [F.col("o_orderdate"), F.col("o_orderkey")], 10).select("o_orderkey", day("o_orderdate").alias("order_day"))


@query("""SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01') WHERE r = 1""")
def first_future_per_customer(spark, d):
    rows = table(spark, d, "orders").filter(F.col("o_orderdate") >= today()).withColumn("_at", F.struct("o_orderdate", "o_orderkey"))
    return ranking.keep_first(rows, ["o_custkey"], "_at").select("o_custkey", "o_orderkey", day("o_orderdate").alias("order_day"))


@query("SELECT n_nationkey, n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def zero_filled_counts(spark, d):
    return reports.zero_filled(table(spark, d, "nation"), "n_nationkey", table(spark, d, "supplier"), "s_nationkey").select("n_nationkey", "n_name", "n")


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS order_day, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' ORDER BY o_orderdate, o_orderkey LIMIT 120) GROUP BY 1""")
def calendar_groups(spark, d):
    rows = ranking.top(table(spark, d, "orders").filter(F.col("o_orderdate") >= today()), [F.col("o_orderdate"), F.col("o_orderkey")], 120)
    return rows.groupBy(day("o_orderdate").alias("order_day")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("ids"))


@query("""WITH planned AS (SELECT o_orderkey, o_orderdate, c_nationkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = 7),
near AS (SELECT DISTINCT d FROM (SELECT CAST(o_orderdate AS DATE) + CAST(k AS INTEGER) AS d FROM planned, range(-3, 4) AS r(k))),
c AS (SELECT o_orderkey, o_orderdate, o_custkey, c_nationkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1998-07-01' AND o_custkey <> 7),
s AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day, concat_ws(',', CASE WHEN c_nationkey IN (SELECT c_nationkey FROM planned) THEN 'same place' END, CASE WHEN c_mktsegment IN (SELECT c_mktsegment FROM planned) THEN 'same kind' END, CASE WHEN CAST(o_orderdate AS DATE) IN (SELECT d FROM near) THEN 'near date' END, CASE WHEN o_totalprice > 400000 THEN 'popular' END) AS reasons FROM c)
SELECT o_orderkey, order_day, reasons FROM s WHERE reasons <> '' ORDER BY len(string_split(reasons, ',')) DESC, order_day, o_orderkey LIMIT 12""")
def recommendation_reasons(spark, d):
    """What a customer might like besides own orders, by number of reasons."""
    own = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    mine = own.filter("o_custkey = 7")
    near = mine.select(F.explode(F.sequence(F.date_sub(F.to_date("o_orderdate"), 3), F.date_add(F.to_date("o_orderdate"), 3))).alias("_day")).distinct()
    places, kinds = mine.select(F.col("c_nationkey").alias("_nation")).distinct(), mine.select(F.col("c_mktsegment").alias("_kind")).distinct()
    rest = own.filter((F.col("o_orderdate") >= today()) & (F.col("o_custkey") != 7)).join(near, F.to_date("o_orderdate") == F.col("_day"), "left").join(places, F.col("c_nationkey") == F.col("_nation"), "left").join(kinds, F.col("c_mktsegment") == F.col("_kind"), "left")
    reasons = F.array_compact(F.array(F.when(F.col("_nation").isNotNull(), "same place"), F.when(F.col("_kind").isNotNull(), "same kind"), F.when(F.col("_day").isNotNull(), "near date"), F.when(F.col("o_totalprice") > 400000, "popular")))
    rows = rest.select("o_orderkey", day("o_orderdate").alias("order_day"), reasons.alias("r")).filter(F.size("r") > 0)
    return ranking.top(rows, [F.size("r").desc(), F.col("order_day"), F.col("o_orderkey")], 12).select("o_orderkey", "order_day", F.array_join("r", ",").alias("reasons"))


@query("""WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (1, 2, 3)) SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM o) AND l_partkey NOT IN (1, 2, 3)""")
def co_occurring_parts(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    followed = lines.filter(F.col("l_partkey").isin(1, 2, 3))
    return lines.join(followed.select("l_orderkey").distinct(), "l_orderkey", "left_semi").filter(~F.col("l_partkey").isin(1, 2, 3)).select("l_partkey").distinct()


@query("""SELECT a.o_custkey, a.o_orderkey AS planned, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 3 WHERE a.o_orderstatus = 'O' AND b.o_orderstatus = 'P'""")
def band_join_dates(spark, d):
    own = table(spark, d, "orders").withColumn("o_day", F.to_date("o_orderdate"))
    a = own.filter("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("planned"), F.col("o_day").alias("a_day"))
    b = own.filter("o_orderstatus = 'P'").select("o_custkey", F.col("o_orderkey").alias("other"), F.col("o_day").alias("b_day"))
    return pairs.band_join(a, b, "o_custkey", "a_day", "b_day", 3).select("o_custkey", "planned", "other")


def related_of(spark, d, lineitem):
    lines = lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s")).distinct()
    future = lines.join(table(spark, d, "orders").filter(F.col("o_orderdate") >= today()).select(F.col("o_orderkey").alias("k"), "o_orderdate"), "k")
    near = ranking.per_key(future, ["s"], [F.col("o_orderdate"), F.col("k")], 5).withColumnRenamed("k", "related")
    met = lines.filter("k % 20 = 0").join(near, "s").filter("k <> related").select(F.col("k").alias("o_orderkey"), "related", "o_orderdate").distinct()
    place = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("o_orderdate", "related"))
    return met.withColumn("place", place).filter("place <= 4").select("o_orderkey", "related", "place")


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem), p AS (SELECT DISTINCT a.k AS o_orderkey, b.k AS related, o_orderdate FROM l a JOIN l b ON a.s = b.s AND a.k <> b.k JOIN orders ON o_orderkey = b.k AND o_orderdate >= TIMESTAMP '1998-07-01' WHERE a.k % 20 = 0)
SELECT o_orderkey, related, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate, related) AS r FROM p) WHERE r <= 4""")
def related_top4(spark, d):
    """For every twentieth order, the four earliest future orders that share a supplier. A supplier's future orders meet in
    date order, and only the first few of each can matter, so they are ranked before the join."""
    return related_of(spark, d, table(spark, d, "lineitem"))


@query("""SELECT a.event_id AS a_event_id, b.event_id AS b_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND a.event_id < b.event_id WHERE a.event_type = b.event_type AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 900000000""")
def same_slot_pairs(spark, d):
    """Pairs of a user's events of a kind and day within a quarter of an hour."""
    rows = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("slot"), "event_type", "ts")
    return pairs.near_pairs(rows, ["user_id", "slot", "event_type"], "event_id", "ts", 900).select("a_event_id", "b_event_id")


@query("""SELECT a.user_id, a.event_id AS a_event_id, b.event_id AS b_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.ts < b.ts + INTERVAL 150 MINUTE AND b.ts < a.ts + INTERVAL 150 MINUTE""")
def interval_overlaps(spark, d):
    spans = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("ts") + F.expr("INTERVAL 150 MINUTES")).alias("te"))
    return pairs.interval_overlaps(spans, ["user_id"], "event_id", "ts", "te", 9000).select("user_id", "a_event_id", "b_event_id")


@query("""SELECT p.event_id AS departure, s.event_id AS within FROM events p JOIN events s ON p.user_id = s.user_id AND p.ts > s.ts AND p.ts < s.ts + INTERVAL 150 MINUTE WHERE p.event_type = 'click' AND s.event_type = 'purchase'""")
def interval_stab(spark, d):
    e = table(spark, d, "events")
    points = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("departure"), F.col("ts").alias("at"))
    spans = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("within"), "ts", (F.col("ts") + F.expr("INTERVAL 150 MINUTES")).alias("te"))
    return pairs.interval_stab(points, spans, ["user_id"], "at", "ts", "te", 9000).select("departure", "within")


@query("""SELECT conv_id, turn, len(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant')) WHERE r = 1""")
def last_relevant_turn(spark, d):
    rows = table(spark, d, "conversations").filter(F.col("role").isin("user", "assistant")).withColumn("seq", F.lit(0)).select("conv_id", "turn", "seq", F.char_length("text").cast("long").alias("n"))
    return ranking.latest(rows, ["conv_id"], "turn", "seq").select("conv_id", "turn", "n")


@query("""WITH t AS (SELECT o_custkey, o_orderkey, o_orderdate AS moment, 'order' AS kind FROM orders UNION ALL SELECT o_custkey, o_orderkey, l_shipdate, 'ship' FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT o_custkey, o_orderkey, o_orderdate + INTERVAL 30 DAY, 'due' FROM orders),
m AS (SELECT o_custkey, min(moment) FILTER (moment > TIMESTAMP '1998-07-01') AS next, max(moment) FILTER (moment <= TIMESTAMP '1998-07-01') AS now FROM t GROUP BY 1)
SELECT o_custkey, o_orderkey, kind, strftime(moment, '%Y-%m-%d') AS item_day, CASE WHEN moment = next THEN 'next' WHEN moment = now THEN 'current' ELSE '' END AS state FROM t JOIN m USING (o_custkey)""")
def timeline_union(spark, d):
    """Each customer's timeline, with the current and the next moment marked."""
    o = table(spark, d, "orders")
    item = lambda df, at, kind: df.select("o_custkey", "o_orderkey", at.alias("at"), F.lit(kind).alias("kind"))
    t = item(o, F.col("o_orderdate"), "order").unionByName(item(o.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")), F.col("l_shipdate"), "ship")).unionByName(item(o, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), "due"))
    at = F.lit(TODAY).cast("timestamp")
    marks = t.groupBy("o_custkey").agg(F.min(F.when(F.col("at") > at, F.col("at"))).alias("next"), F.max(F.when(F.col("at") <= at, F.col("at"))).alias("current"))
    state = F.when(F.col("at") == F.col("next"), "next").when(F.col("at") == F.col("current"), "current").otherwise("")
    return t.join(marks, "o_custkey").select("o_custkey", "o_orderkey", "kind", day("at").alias("item_day"), state.alias("state"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(month(o_orderdate) AS VARCHAR) || '/' || CAST(day(o_orderdate) AS VARCHAR) || '(' || list_extract(['日','月','火','水','木','金','土'], CAST(dayofweek(o_orderdate) + 1 AS INTEGER)) || ')' AS label, strftime(o_orderdate, '%Y/%m/%d') || '(' || list_extract(['日','月','火','水','木','金','土'], CAST(dayofweek(o_orderdate) + 1 AS INTEGER)) || ')' AS full_label,
CASE WHEN n = 0 THEN '今天' WHEN n = 1 THEN '明天' WHEN n = 2 THEN '后天' WHEN n < 0 THEN '已结束' WHEN n <= 60 THEN n || '天后' ELSE '' END AS relative, strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%d') AS local_day FROM (SELECT *, date_diff('day', DATE '1998-07-01', CAST(o_orderdate AS DATE)) AS n FROM orders)""")
def date_labels(spark, d):
    c = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", clock.iso_date(F.year(c), F.month(c), F.dayofmonth(c)).alias("iso"), clock.date_label(c).alias("label"), clock.full_date_label(c).alias("full_label"), clock.relative_day(c, today()).alias("relative"), clock.local_date(F.col("o_orderdate")).alias("local_day"))


@query("SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(14, 2)) * 0.048) AS BIGINT) AS cny, CAST(round(CAST(p_retailprice AS DECIMAL(14, 2)) * 0.0066, 2) AS DOUBLE) AS usd FROM part")
def currency_labels(spark, d):
    return table(spark, d, "part").select("p_partkey", status.yen_in_yuan(F.col("p_retailprice")).alias("cny"), status.yen_in_dollars(F.col("p_retailprice")).alias("usd"))


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN max(l_shipdate) END AS due FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus)
SELECT CASE WHEN due IS NULL THEN 'unknown' WHEN due < TIMESTAMP '1998-07-01' THEN 'overdue' WHEN CAST(due AS DATE) = DATE '1998-07-01' THEN 'today' WHEN due <= TIMESTAMP '1998-07-08' THEN 'week' ELSE 'later' END AS due_group, count(*) AS n FROM d GROUP BY 1""")
def deadline_groups(spark, d):
    due = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("due"))
    rows = table(spark, d, "orders").join(due, "o_orderkey", "left").withColumn("due", F.when(F.col("o_orderstatus") != "F", F.col("due")))
    return rows.groupBy(clock.deadline_group(F.col("due"), F.lit(TODAY).cast("timestamp")).alias("due_group")).agg(F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages),
q AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT list_contains(['fbclid','gclid','igshid','ref','source','utm_campaign','utm_content','utm_medium','utm_source','utm_term'], lower(split_part(x, '=', 1))))) AS kept FROM p)
SELECT page_id, scheme || '://' || host || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url FROM q""")
def canonical_urls(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical_url"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '(?i)&(nbsp|amp|lt|gt|quot|#39);', ' ', 'g'), '\s+', ' ', 'g')) AS visible FROM pages""")
def visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.visible_text(F.col("html")).alias("visible"))


@query(r"""WITH n AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\b([0-9]+)\b', 1), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END)) AS found, text IS NULL AS none FROM documents)
SELECT doc_id, CASE WHEN NOT none THEN array_to_string(list_transform(list_sort(list_transform(found, lambda x: {'l': len(x), 'x': x})), lambda s: s.x), ',') END AS numbers FROM n""")
def extract_numbers(spark, d):
    """The distinct numbers of each text, of any length, by size."""
    digits = F.regexp_extract_all("text", F.lit(r"\b([0-9]+)\b"), F.lit(1))
    plain = F.transform(digits, lambda x: F.coalesce(F.nullif(F.ltrim(x, F.lit("0")), F.lit("")), F.lit("0")))
    ordered = F.array_sort(F.array_distinct(F.transform(plain, lambda x: F.struct(F.char_length(x).alias("l"), x.alias("x")))))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(ordered, lambda s: s["x"]), ",").alias("numbers"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def json_props(spark, d):
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\s')) AS BIGINT) AS links FROM pages""")
def html_title_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit(r"(?i)<a\s")).cast("long").alias("links"))
