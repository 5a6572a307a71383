"""Rules, guards, work queues and review gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo.operators import control, fusion
from confluo.plans.catalogue import query, table


@query("""SELECT path, rule FROM (SELECT CAST(o_orderkey AS VARCHAR) AS path, unnest([CASE WHEN o_totalprice > 499000 THEN 'price above limit' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status unknown' END, CASE WHEN o_orderdate >= TIMESTAMP '2001-08-01' THEN 'date beyond horizon' END]) AS rule FROM orders) WHERE rule IS NOT NULL
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'customer missing' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -900) UNION ALL SELECT CAST(k AS VARCHAR), 'duplicate id' FROM (SELECT l_orderkey * 10 + l_linenumber AS k FROM lineitem GROUP BY 1 HAVING count(*) > 1)""")
def rule_violations(spark, d):
    o = table(spark, d, "orders")
    own = control.violations(o, F.col("o_orderkey"), {"price above limit": F.col("o_totalprice") > 499000, "status unknown": ~F.col("o_orderstatus").isin("O", "F"), "date beyond horizon": F.col("o_orderdate") >= F.lit("2001-08-01").cast("timestamp")})
    missing = control.missing_references(o, "o_orderkey", "o_custkey", table(spark, d, "customer").filter("c_acctbal > -900"), "c_custkey", "customer missing")
    return control.union_all([own, missing, control.duplicate_keys(table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")), "k")])


def guarded(lines):
    """Lines as offers before (small quantities) and after (large ones)."""
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")
    line = lines.groupBy(key, F.col("l_orderkey").alias("id")).agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"), F.min("l_quantity").alias("q"))
    verified = (F.col("f") == "A").alias("verified")
    old = line.filter("q <= 40").select("key", "id", F.when(F.col("s") == "O", "event_detail").otherwise("search").alias("url_kind"), F.lit("available").alias("inventory"), verified, F.when(F.col("f") == "N", "unknown").otherwise(F.col("f")).alias("flag"))
    new = line.filter("q >= 10").select("key", "id", F.when(F.col("q") > 20, "event_detail").otherwise("search").alias("url_kind"), F.when(F.col("f") == "R", "sold_out").otherwise("available").alias("inventory"), verified, F.col("f").alias("flag"))
    before = old.select("id").distinct().withColumn("status", F.lit("on_sale"))
    after = new.groupBy("id").agg(F.when(F.count_if(F.col("inventory") == "sold_out") > 0, "sold_out").otherwise("on_sale").alias("status"))
    return control.publish_blockers(before, after, old, new, line.filter("q < 5").select("key"), ["flag"])


@query("""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS key, l_orderkey AS id, min(l_returnflag) AS f, min(l_linestatus) AS s, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
b AS (SELECT key, id, CASE WHEN s = 'O' THEN 'event_detail' ELSE 'search' END AS url_kind, f = 'A' AS verified, CASE WHEN f = 'N' THEN 'unknown' ELSE f END AS flag FROM l WHERE q <= 40),
a AS (SELECT key, id, CASE WHEN q > 20 THEN 'event_detail' ELSE 'search' END AS url_kind, CASE WHEN f = 'R' THEN 'sold_out' ELSE 'available' END AS inventory, f = 'A' AS verified, f AS flag FROM l WHERE q >= 10),
eb AS (SELECT DISTINCT id, 'on_sale' AS status FROM b), ea AS (SELECT id, CASE WHEN count(*) FILTER (WHERE inventory = 'sold_out') > 0 THEN 'sold_out' ELSE 'on_sale' END AS status, count(*) FILTER (WHERE inventory = 'sold_out') AS n FROM a GROUP BY 1),
gone AS (SELECT * FROM b WHERE key NOT IN (SELECT key FROM a))
SELECT 'event_ids_changed' AS code, CAST(id AS VARCHAR) AS key FROM ea WHERE id NOT IN (SELECT id FROM eb) UNION ALL SELECT 'event_ids_changed', CAST(id AS VARCHAR) FROM eb WHERE id NOT IN (SELECT id FROM ea)
UNION ALL SELECT 'valid_offer_removed_without_evidence', CAST(key AS VARCHAR) FROM gone WHERE verified AND key NOT IN (SELECT key FROM l WHERE q < 5)
UNION ALL SELECT 'detail_url_downgraded', CAST(key AS VARCHAR) FROM gone WHERE url_kind = 'event_detail' AND id IN (SELECT id FROM a WHERE url_kind = 'search')
UNION ALL SELECT 'single_offer_promoted_to_event_sold_out', CAST(id AS VARCHAR) FROM ea WHERE status = 'sold_out' AND n <= 1 AND id IN (SELECT id FROM eb)
UNION ALL SELECT 'unverified_fields_became_known', CAST(a.key AS VARCHAR) FROM a JOIN b USING (key) WHERE b.flag = 'unknown' AND a.flag <> 'unknown' AND NOT a.verified""")
def publish_guard(spark, d):
    """Lines as offers before (small quantities) and after (large ones)."""
    return guarded(table(spark, d, "lineitem"))


@query("""WITH j AS (SELECT event_id AS seq, 'u' || event_id AS url, 'e' || user_id AS event_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'deferred' ELSE 'done' END AS status, ts AS next_check FROM events),
m AS (SELECT *, status = 'deferred' AND next_check <= TIMESTAMP '2024-01-02' AS due, status IN ('pending', 'deferred') AND url IN ('u5', 'u17') AS by_url, status IN ('pending', 'deferred') AND event_id IN ('e3', 'e8') AS by_event FROM j),
c AS (SELECT seq, url, status, concat_ws(',', CASE WHEN due THEN 'due' END, CASE WHEN by_url THEN 'url' END, CASE WHEN by_event THEN 'event' END) AS reasons FROM m WHERE due OR by_url OR by_event),
p AS (SELECT seq, url, status, 'pending limit' AS reasons, row_number() OVER (ORDER BY seq) AS nth FROM m WHERE status = 'pending' AND NOT (due OR by_url OR by_event)),
s AS (SELECT * FROM c UNION ALL SELECT seq, url, status, reasons FROM p WHERE nth <= 10 - least(10, (SELECT count(*) FROM c WHERE status = 'pending')))
SELECT *, row_number() OVER (ORDER BY seq) <= 50 AS selected FROM s""")
def frontier_selection(spark, d):
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "deferred").otherwise("done")
    jobs = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("event_id")).alias("url"), F.concat(F.lit("e"), F.col("user_id")).alias("event_id"), status.alias("status"), F.col("ts").alias("next_check"))
    return control.select_jobs(jobs, F.lit("2024-01-02").cast("timestamp"), ["u5", "u17"], ["e3", "e8"], 10, 50)


@query("""WITH m AS (SELECT doc_id, unnest(['title', 'date']) AS field, unnest([sha256(coalesce(lang, '')), sha256(coalesce(source, ''))]) AS h, unnest([n_chars > 5000, FALSE]) AS conflict FROM documents),
r AS (SELECT doc_id, unnest(['title', 'date']) AS field, unnest([sha256('en'), CASE WHEN quality = 1 THEN NULL ELSE sha256('src1') END]) AS a FROM labels),
s AS (SELECT m.doc_id, m.field, CASE WHEN conflict THEN 'conflict' WHEN a IS NULL THEN 'pending_review' WHEN a <> h THEN 'changed' ELSE 'approved' END AS st FROM m LEFT JOIN r ON m.doc_id = r.doc_id AND m.field = r.field)
SELECT doc_id, count(*) FILTER (WHERE st = 'approved') AS approved_fields, CASE WHEN bool_and(st = 'approved') THEN 'approved' ELSE 'candidate' END AS review_state FROM s GROUP BY 1""")
def review_gate(spark, d):
    """Documents as candidates with two fields, labels as reviews of them."""
    field = lambda name, value, conflict: F.struct(F.lit(name).alias("field"), F.sha2(F.coalesce(value, F.lit("")), 256).alias("approval_hash"), F.when(conflict, "conflicting_sources").otherwise("published").alias("availability_status"))
    merged = table(spark, d, "documents").select("doc_id", F.explode(F.array(field("title", F.col("lang"), F.col("n_chars") > 5000), field("date", F.col("source"), F.lit(False)))).alias("f")).select("doc_id", "f.*")
    review = lambda name, h: F.struct(F.lit(name).alias("field"), h.alias("approved_hash"))
    reviews = table(spark, d, "labels").select("doc_id", F.explode(F.array(review("title", F.sha2(F.lit("en"), 256)), review("date", F.when(~F.col("quality").eqNullSafe(1), F.sha2(F.lit("src1"), 256))))).alias("f")).select("doc_id", "f.*")
    return fusion.gate(fusion.apply_approvals(merged, reviews, ["doc_id"]), ["doc_id"], required=("title", "date"))


@query("""SELECT CASE WHEN v < 5 THEN 'blocked' WHEN v < 20 THEN 'invalid' WHEN v < 40 THEN 'deferred' WHEN user_id % 2 = 0 THEN 'done' ELSE 'unmatched' END AS outcome, count(*) AS n FROM (SELECT user_id, value AS v FROM events) GROUP BY 1""")
def frontier_outcomes(spark, d):
    from confluo.functions.status import outcome

    v = F.col("value")
    http = F.when(v < 5, 403).when(v < 20, 404).when(v < 40, 503).otherwise(200)
    return table(spark, d, "events").groupBy(outcome(http, F.col("user_id") % 2 == 0, F.lit(True)).alias("outcome")).agg(F.count("*").alias("n"))
