"""User state: plans, tasks, trips, mutations, next steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from confluo.operators import ranking, sets
from confluo.plans.catalogue import query, table
from confluo.plans.reads import TODAY, day, today


@query("""SELECT o_custkey, o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-07-01' THEN 'upcoming' ELSE 'past' END AS part, CASE WHEN o_orderdate >= TIMESTAMP '1998-07-01' THEN row_number() OVER (PARTITION BY o_custkey, o_orderdate >= TIMESTAMP '1998-07-01' ORDER BY o_orderdate, o_orderkey) ELSE row_number() OVER (PARTITION BY o_custkey, o_orderdate >= TIMESTAMP '1998-07-01' ORDER BY o_orderdate DESC, o_orderkey) END AS place FROM orders""")
def upcoming_and_past(spark, d):
    """A customer's orders: upcoming ones by rising date, past ones by falling date. One window serves both parts."""
    up = F.col("o_orderdate") >= today()
    rows = table(spark, d, "orders").withColumn("part", F.when(up, "upcoming").otherwise("past"))
    distance = F.abs(F.unix_micros("o_orderdate") - F.unix_micros(F.lit(TODAY).cast("timestamp")))
    return rows.select("o_custkey", "o_orderkey", "part", F.row_number().over(Window.partitionBy("o_custkey", "part").orderBy(distance, "o_orderkey")).cast("long").alias("place"))


@query("""SELECT o_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') AS departs FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate GROUP BY 1""")
def first_return_leg(spark, d):
    legs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return legs.join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").filter("l_shipdate > o_orderdate").groupBy("o_orderkey").agg(day(F.min("l_shipdate")).alias("departs"))


@query("""SELECT l_orderkey, bool_or(l_partkey = 5) AS contains_it, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1""")
def containing_trips(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_partkey") == 5).alias("contains_it"), F.count_distinct("l_partkey").alias("parts"))


@query("""SELECT o_orderkey, l_linenumber, l_partkey, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_linestatus = 'O'""")
def open_tasks(spark, d):
    lines = table(spark, d, "lineitem").filter("l_linestatus = 'O'")
    return lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "l_linenumber", "l_partkey", "c_name")


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'planned' ELSE 'free' END AS state FROM customer""")
def planned_and_free(spark, d):
    """A semi join and its complement."""
    c, big = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return c.join(big, "c_custkey", "left_semi").withColumn("state", F.lit("planned")).unionByName(c.join(big, "c_custkey", "left_anti").withColumn("state", F.lit("free")))


@query("""SELECT l_orderkey, count(*) FILTER (WHERE p_partkey IS NULL) AS missing, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS kinds FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 45) ON l_partkey = p_partkey GROUP BY 1""")
def trip_references(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "part").filter("p_size <= 45"), F.col("l_partkey") == F.col("p_partkey"), "left")
    kinds = F.array_join(F.array_sort(F.collect_set("p_type")), ",")
    return joined.groupBy("l_orderkey").agg(F.count_if(F.col("p_partkey").isNull()).alias("missing"), F.when(F.count("p_partkey") > 0, kinds).alias("kinds"))


@query("""WITH p AS (SELECT DISTINCT user_id, 'plan' AS origin FROM events WHERE event_type = 'purchase'), w AS (SELECT DISTINCT user_id, 'want' AS origin FROM events WHERE event_type = 'view') SELECT * FROM p UNION ALL SELECT * FROM w WHERE user_id NOT IN (SELECT user_id FROM p)""")
def merge_missing_keys(spark, d):
    e = table(spark, d, "events")
    plans = e.filter("event_type = 'purchase'").select("user_id").distinct().withColumn("origin", F.lit("plan"))
    wants = e.filter("event_type = 'view'").select("user_id").distinct().withColumn("origin", F.lit("want"))
    return sets.upsert(wants, plans, ["user_id"])


@query("""WITH old AS (SELECT user_id, max(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), new AS (SELECT user_id, max(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type = 'purchase' GROUP BY 1), gone AS (SELECT user_id FROM events GROUP BY 1 HAVING arg_max(event_type, {'t': ts, 'i': event_id}) = 'error')
SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new) AND user_id NOT IN (SELECT user_id FROM gone) UNION ALL SELECT * FROM new""")
def user_mutations(spark, d):
    e = table(spark, d, "events")
    best = lambda rows: rows.groupBy("user_id").agg(F.max("value").alias("v"))
    return sets.upsert(best(e.filter("ts < '2024-01-16'")), best(e.filter("ts >= '2024-01-16' and event_type = 'purchase'")), ["user_id"], e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last")).filter("last = 'error'"))


@query("""WITH a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 250000 THEN 'pay' WHEN o_orderstatus = 'F' THEN 'await result' WHEN o_orderdate <= TIMESTAMP '1998-07-01' AND o_orderstatus = 'O' THEN 'apply' WHEN o_orderdate > TIMESTAMP '1998-07-01' THEN 'wait' END AS label, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate + INTERVAL 10 DAY END AS due FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY due ASC NULLS LAST, o_orderkey) AS n FROM a WHERE label IS NOT NULL AND (due IS NULL OR due >= TIMESTAMP '1998-07-01')) SELECT o_custkey, o_orderkey, label, strftime(due, '%Y-%m-%d') AS due_day FROM r WHERE n = 1""")
def next_actions(spark, d):
    """Each customer's next step: by due day, none last, then id."""
    status, early = F.col("o_orderstatus"), F.col("o_orderdate") <= today()
    label = F.when((status == "F") & (F.col("o_totalprice") > 250000), "pay").when(status == "F", "await result").when(early & (status == "O"), "apply").when(~early, "wait")
    rows = table(spark, d, "orders").withColumns({"label": label, "due": F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate") + F.expr("INTERVAL 10 DAYS"))})
    rows = rows.filter(F.col("label").isNotNull() & (F.col("due").isNull() | (F.col("due") >= today())))
    first = ranking.keep_first(rows.withColumn("_o", F.struct(F.col("due").isNull().alias("n"), "due", "o_orderkey")).select("o_custkey", "o_orderkey", "label", "due", "_o"), ["o_custkey"], "_o")
    return first.select("o_custkey", "o_orderkey", "label", day("due").alias("due_day"))


@query("""WITH r AS (SELECT l_orderkey, unnest([CASE WHEN l_discount > 0.05 THEN 'coupon' END, CASE WHEN l_tax > 0.05 THEN 'receipt' END, CASE WHEN l_returnflag = 'R' THEN 'identity' END]) AS label, l_partkey FROM lineitem) SELECT l_orderkey, label, min(l_partkey) AS first_part FROM r WHERE label IS NOT NULL GROUP BY 1, 2""")
def checklist_suggestions(spark, d):
    labels = F.array_compact(F.array(F.when(F.col("l_discount") > 0.05, "coupon"), F.when(F.col("l_tax") > 0.05, "receipt"), F.when(F.col("l_returnflag") == "R", "identity")))
    return table(spark, d, "lineitem").select("l_orderkey", F.explode(labels).alias("label"), "l_partkey").groupBy("l_orderkey", "label").agg(F.min("l_partkey").alias("first_part"))


@query("""SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name, coalesce(CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_acctbal END, 0) AS pop FROM customer) ORDER BY pop DESC, c_custkey LIMIT 12""")
def picker_topk(spark, d):
    rows = table(spark, d, "customer").withColumn("pop", F.coalesce(F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal")), F.lit(0.0)))
    return ranking.top(rows, [F.col("pop").desc(), F.col("c_custkey")], 12).select("c_custkey", "c_name")


def by_price(spark, d, since):
    price = table(spark, d, "lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_extendedprice").alias("price"))
    rows = table(spark, d, "orders").filter(F.col("o_orderdate") >= F.lit(since).cast("timestamp")).join(price, "o_orderkey", "left")
    return ranking.top(rows, [F.col("price").asc_nulls_last(), F.col("o_orderdate"), F.col("o_orderkey")], 50).select("o_orderkey", day("o_orderdate").alias("order_day"), "price")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day, min(l_extendedprice) AS price FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'N' WHERE o_orderdate >= TIMESTAMP '1998-07-01' GROUP BY o_orderkey, o_orderdate ORDER BY min(l_extendedprice) NULLS LAST, o_orderdate, o_orderkey LIMIT 50""")
def price_order_topk(spark, d):
    """Sorted by price, missing ones last, then date, then id."""
    return by_price(spark, d, TODAY)