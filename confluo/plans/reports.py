"""Reports: coverage, funnels, histograms, freshness, deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo.functions import clock
from confluo.operators import ranking, reports
from confluo.plans.catalogue import query, table
from confluo.plans.reads import now


@query("""WITH j AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT count(*) AS total, count(quality) AS labelled, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE n_chars > 1000) AS long FROM j)
SELECT field, covered, total, coalesce(round(100.0 * covered / nullif(total, 0), 1), 0) AS share FROM (SELECT 'labelled' AS field, labelled AS covered, total FROM c UNION ALL SELECT 'good', good, total FROM c UNION ALL SELECT 'toxic', toxic, total FROM c UNION ALL SELECT 'long', long, total FROM c)""")
def coverage_percentages(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return reports.coverage(rows, labelled=F.col("quality").isNotNull(), good=F.col("quality") == 1, toxic=F.col("toxic") == 1, long=F.col("n_chars") > 1000)


@query("""SELECT count(*) AS discovered, count(*) FILTER (WHERE quality IS NOT NULL) AS reviewed, count(*) FILTER (WHERE quality = 1) AS ready, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS approved FROM documents LEFT JOIN labels USING (doc_id)""")
def publish_funnel(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return reports.counts(rows, discovered=F.lit(True), reviewed=F.col("quality").isNotNull(), ready=F.col("quality") == 1, approved=(F.col("quality") == 1) & (F.col("toxic") == 0))


@query("""SELECT a.o_orderpriority, b.o_orderstatus, count(o_orderkey) AS n FROM (SELECT DISTINCT o_orderpriority FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) b LEFT JOIN orders o ON o.o_orderpriority = a.o_orderpriority AND o.o_orderstatus = b.o_orderstatus GROUP BY 1, 2""")
def dense_histogram(spark, d):
    o = table(spark, d, "orders")
    dense = o.select("o_orderpriority").distinct().crossJoin(o.select("o_orderstatus").distinct())
    found = reports.dense_histogram(o, "o_orderpriority", "o_orderstatus")
    return dense.join(found, ["o_orderpriority", "o_orderstatus"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("""SELECT source, lang, count(*) AS n, count(quality) AS labelled, round(100.0 * count(quality) / count(*), 1) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def source_contributions(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source", "lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.round(100.0 * F.count("quality") / F.count("*"), 1).alias("share"))


@query("""SELECT field, count(*) AS n FROM (SELECT unnest([CASE WHEN l_discount = 0 THEN 'discount' END, CASE WHEN l_tax = 0 THEN 'tax' END, CASE WHEN l_quantity < 5 THEN 'quantity' END, CASE WHEN l_returnflag = 'N' THEN 'returnflag' END]) AS field FROM lineitem) WHERE field IS NOT NULL GROUP BY 1""")
def unpivot_queue(spark, d):
    """A row for each field of each line that is to be looked at, counted by field."""
    open_fields = F.array_compact(F.array(F.when(F.col("l_discount") == 0, "discount"), F.when(F.col("l_tax") == 0, "tax"), F.when(F.col("l_quantity") < 5, "quantity"), F.when(F.col("l_returnflag") == "N", "returnflag")))
    return table(spark, d, "lineitem").select(F.explode(open_fields).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(DISTINCT user_id) AS expected, count(DISTINCT user_id) FILTER (WHERE value > 50) AS success, greatest(0, count(DISTINCT user_id) - count(DISTINCT user_id) FILTER (WHERE value > 50)) AS missed FROM events GROUP BY 1""")
def source_audit(spark, d):
    ok = F.count_distinct(F.when(F.col("value") > 50, F.col("user_id")))
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("expected"), ok.alias("success")).withColumn("missed", F.greatest(F.lit(0).cast("long"), F.col("expected") - F.col("success")))


@query("""WITH h AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS half, count(*) AS events, count(DISTINCT user_id) AS users, count(*) - count(DISTINCT user_id) AS repeats, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1),
u AS (SELECT half, unnest(['events', 'users', 'repeats', 'errors']) AS metric, unnest([events, users, repeats, errors]) AS value FROM h)
SELECT metric, a.value AS before, b.value AS after, b.value - a.value AS change, round(100.0 * (b.value - a.value) / nullif(a.value, 0), 1) AS percent FROM (SELECT * FROM u WHERE half = 0) a FULL JOIN (SELECT * FROM u WHERE half = 1) b USING (metric)""")
def kpi_delta(spark, d):
    def kpis(rows):
        one = rows.agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"))
        return reports.unpivot(one.select("events", "users", (F.col("events") - F.col("users")).alias("repeats"), "errors"), "metric", "value")

    e = table(spark, d, "events")
    return reports.delta(kpis(e.filter(F.col("ts") < now())), kpis(e.filter(F.col("ts") >= now())))


@query("""WITH a AS (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE (epoch_us(TIMESTAMP '2024-01-16') - epoch_us(ts)) / 3600000000.0 END AS h FROM events WHERE ts < TIMESTAMP '2024-01-16')
SELECT CASE WHEN h IS NULL THEN 'unknown' WHEN h < 24 THEN '<24h' WHEN h < 72 THEN '1-3d' WHEN h <= 168 THEN '3-7d' ELSE '>7d' END AS bucket, count(*) AS n FROM a GROUP BY 1""")
def freshness_buckets(spark, d):
    age = F.when(F.col("event_type") != "error", (F.unix_micros(now()) - F.unix_micros("ts")) / 3_600_000_000)
    return table(spark, d, "events").filter(F.col("ts") < now()).groupBy(clock.freshness_bucket(age).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT event_type, round(median(value), 6) AS median_value, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def median_samples(spark, d):
    found = reports.exact_percentiles(table(spark, d, "events"), "event_type", "value", {"median_value": 0.5, "p90": 0.9})
    return found.select("event_type", F.round("median_value", 6).alias("median_value"), F.round("p90", 6).alias("p90"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS watching, count(*) FILTER (WHERE event_type IN ('click', 'signup', 'purchase')) AS active, count(*) FILTER (WHERE event_type = 'purchase') AS bought, round(sum(value) FILTER (WHERE event_type = 'purchase'), 2) AS paid,
CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 10 THEN 'won' WHEN count(*) FILTER (WHERE event_type = 'signup') > 10 THEN 'applied' WHEN count(*) FILTER (WHERE event_type = 'error') > 10 THEN 'failed' ELSE 'none' END AS section FROM events GROUP BY 1""")
def overlapping_status_counts(spark, d):
    kind = lambda *k: F.col("event_type").isin(*k)
    n = lambda k: F.count_if(kind(k)) > 10
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(kind("view", "click")).alias("watching"), F.count_if(kind("click", "signup", "purchase")).alias("active"), F.count_if(kind("purchase")).alias("bought"), F.round(F.sum(F.when(kind("purchase"), F.col("value"))), 2).alias("paid"), F.when(n("purchase"), "won").when(n("signup"), "applied").when(n("error"), "failed").otherwise("none").alias("section"))


@query("""SELECT o_orderpriority, count(DISTINCT n_name) AS nations, string_agg(DISTINCT CAST(n_regionkey AS VARCHAR), ',' ORDER BY CAST(n_regionkey AS VARCHAR)) AS regions FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def distinct_regions(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("o_orderpriority").agg(F.count_distinct("n_name").alias("nations"), F.array_join(F.array_sort(F.collect_set(F.col("n_regionkey").cast("string"))), ",").alias("regions"))


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1""")
def latest_per_key(spark, d):
    return ranking.latest(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("""SELECT user_id, event_id, round((epoch_us(TIMESTAMP '2024-01-16') - epoch_us(ts)) / 3600000000.0, 3) AS age_hours FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type <> 'error' AND ts <= TIMESTAMP '2024-01-16') WHERE r = 1 AND TIMESTAMP '2024-01-16' - ts <= INTERVAL 24 HOUR""")
def fresh_cache_hits(spark, d):
    """The last success of each user, if at most a day old."""
    rows = table(spark, d, "events").filter((F.col("event_type") != "error") & (F.col("ts") <= now())).select("user_id", "ts", "event_id")
    age = (F.unix_micros(now()) - F.unix_micros("ts")) / 3_600_000_000
    return ranking.latest(rows, ["user_id"], "ts", "event_id").filter(age.between(0, 24)).select("user_id", "event_id", F.round(age, 3).alias("age_hours"))
