"""Discovery, offers, review batches and publication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from confluo.functions import status, text, urls
from confluo.operators import ranking, reports, resolution
from confluo.plans.catalogue import query, table


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_shipdate, l_partkey, l_linenumber) AS n FROM lineitem) SELECT l_orderkey, l_suppkey, l_partkey, l_returnflag FROM r WHERE n = 1""")
def best_phase_per_url(spark, d):
    """Of several phases behind one link, the one of best status, then of earliest start."""
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = table(spark, d, "lineitem").withColumn("_o", F.struct(rank.alias("r"), "l_shipdate", "l_partkey", "l_linenumber")).select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag", "_o")
    return ranking.keep_first(rows, ["l_orderkey", "l_suppkey"], "_o").drop("_o")


@query("""SELECT l_orderkey, l_partkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_shipdate, l_partkey, l_linenumber) AS INTEGER) AS place FROM lineitem WHERE l_quantity > 2""")
def offer_order(spark, d):
    """Offers by status, then inventory, then end; support links left out."""
    state, stock = F.when(F.col("l_linestatus") == "O", 0).otherwise(1), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(state, stock, "l_shipdate", "l_partkey", "l_linenumber"))
    return table(spark, d, "lineitem").filter("l_quantity > 2").select("l_orderkey", "l_partkey", "l_linenumber", place.alias("place"))


@query("""SELECT regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS name_key, count(*) AS n, count(DISTINCT p_brand) AS sources, min(p_name) AS example FROM part WHERE p_name NOT IN ('small ring', 'red widget', 'blue bolt') GROUP BY 1 ORDER BY n DESC, name_key LIMIT 20""")
def unresolved_discovery(spark, d):
    """Names that no entity has, with how often and in how many sources they come."""
    known = spark.createDataFrame([(1, "small ring"), (2, "red widget"), (3, "blue bolt")], "entity_id int, variant string")
    rest = resolution.unresolved(table(spark, d, "part"), "p_name", known)
    grouped = rest.groupBy(text.normalize_name(F.col("p_name"), compatible=False).alias("name_key")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("sources"), F.min("p_name").alias("example"))
    return ranking.top(grouped, [F.col("n").desc(), F.col("name_key")], 20)


@query("""WITH p AS (SELECT doc_id, CASE WHEN quality IS NULL THEN 'missing' WHEN toxic = 1 THEN 'changed' ELSE 'ready' END AS state FROM documents LEFT JOIN labels USING (doc_id)),
a AS (SELECT state, doc_id // 1000 AS a, count(*) AS n, sha256(string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY doc_id)) AS h FROM p GROUP BY 1, 2), b AS (SELECT state, a // 1000 AS b, sum(n) AS n, sha256(string_agg(h, '|' ORDER BY a)) AS h FROM a GROUP BY 1, 2) SELECT state, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '|' ORDER BY b)) AS batch_hash FROM b GROUP BY 1""")
def review_batch_summary(spark, d):
    """Batches to review with a hash of what they hold; a review counts only for the same hash. Ids are hashed by thousands, these
    hashes by thousands again, so no task holds a batch whole."""
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    state = F.when(F.col("quality").isNull(), "missing").when(F.col("toxic") == 1, "changed").otherwise("ready")
    return reports.batch_hash(rows.select(state.alias("state"), "doc_id"), "state", "doc_id")


@query("""WITH c AS (SELECT doc_id, sha256(lang || '|' || source) AS h FROM documents), a AS (SELECT doc_id, CASE WHEN quality = 1 THEN sha256(lang || '|' || source) ELSE 'old' END AS approved FROM labels JOIN documents USING (doc_id)) SELECT doc_id, h FROM c JOIN a USING (doc_id) WHERE h = approved""")
def publish_entities(spark, d):
    """Entities whose approved hash is that of their present content."""
    now = table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws("|", "lang", "source"), 256).alias("h"))
    approved = table(spark, d, "labels").join(now, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("h")).otherwise("old").alias("h"))
    return now.join(approved, ["doc_id", "h"])


@query("""WITH b AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, max(event_type) AS kind FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), a AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, max(event_type) AS kind FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1),
ub AS (SELECT user_id, unnest(['views', 'purchases', 'kind']) AS field, unnest([CAST(views AS VARCHAR), CAST(purchases AS VARCHAR), kind]) AS v FROM b), ua AS (SELECT user_id, unnest(['views', 'purchases', 'kind']) AS field, unnest([CAST(views AS VARCHAR), CAST(purchases AS VARCHAR), kind]) AS v FROM a)
SELECT user_id, field, ub.v AS before, ua.v AS after, ub.v IS DISTINCT FROM ua.v AS changed FROM ub FULL JOIN ua USING (user_id, field)""")
def verification_matrix(spark, d):
    """A row for each thing and field: before, after, whether it changed."""

    def fields(where):
        n = lambda k: F.count_if(F.col("event_type") == k).cast("string")
        g = table(spark, d, "events").filter(where).groupBy("user_id").agg(n("view").alias("views"), n("purchase").alias("purchases"), F.max("event_type").alias("kind"))
        return g.select("user_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("views", "purchases", "kind")])).alias("f")).select("user_id", "f.*")

    joined = fields("ts < '2024-01-16'").withColumnRenamed("v", "before").join(fields("ts >= '2024-01-16'").withColumnRenamed("v", "after"), ["user_id", "field"], "full_outer")
    return joined.withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


@query("""SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'A' AND l_linestatus = 'O') THEN 0 WHEN bool_or(l_quantity > 45) THEN 1 WHEN bool_or(l_returnflag = 'N') THEN 2 ELSE 3 END AS priority, CASE WHEN bool_or(l_tax = 0) THEN 'no date' WHEN bool_or(l_discount = 0) THEN 'no venue' WHEN count(*) > 5 THEN 'ambiguous' ELSE 'weak' END AS reason FROM lineitem GROUP BY 1""")
def job_priority(spark, d):
    """The priority of a job over all its contexts, and why it stayed unmatched; the first that holds."""
    some = F.bool_or
    priority = F.when(some((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O")), 0).when(some(F.col("l_quantity") > 45), 1).when(some(F.col("l_returnflag") == "N"), 2).otherwise(3)
    reason = F.when(some(F.col("l_tax") == 0), "no date").when(some(F.col("l_discount") == 0), "no venue").when(F.count("*") > 5, "ambiguous").otherwise("weak")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(priority.alias("priority"), reason.alias("reason"))


def conflicts_of(lines):
    """Observed facts against current ones, found by id, else by link."""
    rows = lines.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("url"), F.col("l_returnflag").alias("fact"), "l_linestatus")
    seen, current = rows.filter("l_linestatus = 'O'").drop("l_linestatus"), rows.filter("l_linestatus = 'F'")
    joined = seen.join(current.groupBy("id").agg(F.min("fact").alias("by_id")), "id", "left").join(current.groupBy("url").agg(F.min("fact").alias("by_url")), "url", "left")
    out = joined.withColumn("current_fact", F.coalesce("by_id", "by_url")).filter("current_fact is not null")
    return out.select("id", "url", "fact", "current_fact", (F.col("current_fact") != F.col("fact")).alias("conflicts"))


@query("""WITH o AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_partkey AS url, l_returnflag AS fact FROM lineitem WHERE l_linestatus = 'O'), c AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_partkey AS url, l_returnflag AS fact FROM lineitem WHERE l_linestatus = 'F'),
ci AS (SELECT id, min(fact) AS fact FROM c GROUP BY 1), cu AS (SELECT url, min(fact) AS fact FROM c GROUP BY 1) SELECT o.id, o.url, o.fact, coalesce(ci.fact, cu.fact) AS current_fact, coalesce(ci.fact, cu.fact) <> o.fact AS conflicts FROM o LEFT JOIN ci USING (id) LEFT JOIN cu ON o.url = cu.url WHERE coalesce(ci.fact, cu.fact) IS NOT NULL""")
def observation_conflicts(spark, d):
    """Observed facts against current ones, found by id, else by link."""
    return conflicts_of(table(spark, d, "lineitem"))


def context_of(spark, d, orders):
    rows = table(spark, d, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_partkey", "p_brand"))), lambda x: x["p_brand"])
    return rows.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(names, ",").alias("brands"))


@query("""SELECT o_orderkey, string_agg(p_brand, ',' ORDER BY l_linenumber, p_partkey) AS brands FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def event_context(spark, d):
    """Names attached as an ordered list."""
    return context_of(spark, d, table(spark, d, "orders"))


@query("""WITH l(lead_id, txt) AS (VALUES (1, 'saw a small ring on sale'), (2, 'the red bolt, really red'), (3, 'nothing here')), s AS (SELECT lead_id, p_partkey, CASE WHEN contains(txt, p_name) THEN 5 ELSE 0 END + CASE WHEN contains(txt, split_part(p_name, ' ', 1)) THEN 2 ELSE 0 END + CASE WHEN contains(txt, split_part(p_name, ' ', 2)) THEN 2 ELSE 0 END AS score FROM l, part)
SELECT lead_id, p_partkey, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY score DESC, p_partkey) AS place FROM s WHERE score > 0) WHERE place <= 5""")
def lead_matches(spark, d):
    """Pasted texts against the catalogue, the five best of each: a stated set of leads against all rows."""
    leads = spark.createDataFrame([(1, "saw a small ring on sale"), (2, "the red bolt, really red"), (3, "nothing here")], "lead_id int, txt string")
    has = lambda x, w: F.when(F.contains(F.col("txt"), x), w).otherwise(0)
    score = has(F.col("p_name"), 5) + has(F.split_part("p_name", F.lit(" "), F.lit(1)), 2) + has(F.split_part("p_name", F.lit(" "), F.lit(2)), 2)
    rows = F.broadcast(leads).crossJoin(table(spark, d, "part").select("p_partkey", "p_name")).withColumn("score", score).filter("score > 0")
    place = F.row_number().over(Window.partitionBy("lead_id").orderBy(F.col("score").desc(), "p_partkey"))
    return rows.withColumn("place", place).filter("place <= 5").select("lead_id", "p_partkey", "score", "place")


@query(r"""WITH h AS (SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages), f AS (SELECT host, CASE WHEN starts_with(host, 'm.') THEN 'mobile' WHEN ends_with(host, '.org') THEN 'org' WHEN ends_with(host, '.net') THEN 'net' ELSE 'other' END AS family FROM h) SELECT family, count(*) AS n, count(DISTINCT host) AS hosts, count(*) - count(DISTINCT host) AS duplicates FROM f GROUP BY 1""")
def source_families(spark, d):
    host = urls.host(F.col("url"))
    family = F.when(host.startswith("m."), "mobile").when(host.endswith(".org"), "org").when(host.endswith(".net"), "net").otherwise("other")
    return table(spark, d, "pages").select(host.alias("host"), family.alias("family")).groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"), (F.count("*") - F.count_distinct("host")).alias("duplicates"))


@query("""SELECT event_type AS source_id, count(*) AS attempts, count(*) FILTER (WHERE value >= 10) AS successes, count(*) FILTER (WHERE value < 10) AS failures FROM events GROUP BY 1""")
def evidence_manifest(spark, d):
    from confluo.sources.records import manifest

    fetched = F.when(F.col("value") >= 50, "success").when(F.col("value") >= 10, "cache_reused").otherwise("page_fetch_failed")
    return manifest(table(spark, d, "events").select(F.col("event_type").alias("source_id"), fetched.alias("fetch_status")))


@query("""WITH p AS (SELECT page_id, CASE WHEN regexp_matches(url, '^https') THEN 'publish' ELSE 'phase' END AS origin, length(html) > 3000 AS long FROM pages), u AS (SELECT p.page_id, origin, long FROM p) SELECT origin, long, count(*) AS n, min(page_id) AS first_page FROM u GROUP BY 1, 2""")
def page_origins(spark, d):
    return table(spark, d, "pages").groupBy(F.when(F.col("url").startswith("https"), "publish").otherwise("phase").alias("origin"), (F.char_length("html") > 3000).alias("long")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("""WITH c AS (SELECT unnest(['o_orderpriority', 'o_custkey', 'o_totalprice']) AS field, unnest([count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED'), count(*) FILTER (WHERE o_custkey IS NULL), count(*) FILTER (WHERE o_totalprice IS NULL)]) AS unknown FROM orders) SELECT * FROM c""")
def unknown_counts(spark, d):
    """How many rows do not know each fact."""
    o = table(spark, d, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unknown").otherwise(F.col("o_orderpriority")))
    facts = ("o_orderpriority", "o_custkey", "o_totalprice")
    return reports.unpivot(reports.counts(o, **{c: status.is_unknown(F.col(c)) for c in facts}), "field", "unknown")


@query("""WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN 'Hall ' || o_custkey % 50 END AS name, o_custkey AS c, o_orderkey % 4 AS n FROM orders WHERE o_orderkey % 3 = 0), r AS (SELECT id, name, unnest(CASE n WHEN 0 THEN [] WHEN 1 THEN ['s1'] ELSE ['s1', 's2'] END) AS s, c FROM c WHERE name IS NOT NULL),
h AS (SELECT name, list_sort(list(DISTINCT sha256('' || c % 7)) FILTER (c % 50 <> 3)) AS hashes, count(DISTINCT (s, c)) AS n_sources FROM r GROUP BY 1), g AS (SELECT name, count(*) AS n_events FROM c WHERE name IS NOT NULL GROUP BY 1),
j AS (SELECT g.name, n_events, coalesce(n_sources, 0) AS n_sources, coalesce(hashes, CAST([] AS VARCHAR[])) AS hashes, n_name AS prefecture, CASE WHEN n_regionkey % 2 = 0 THEN 'city ' || n_regionkey END AS city, CASE WHEN n_name IS NOT NULL THEN 'https://place.example/' || n_nationkey END AS url FROM g LEFT JOIN h ON h.name = g.name LEFT JOIN nation ON g.name = 'Hall ' || n_nationkey)
SELECT 'venue-ext-' || substr(sha256(replace(lower(name), ' ', '')), 1, 16) AS id, name AS name_ja, prefecture, city, n_events, n_sources, len(hashes) AS n_hashes, sha256(CAST(to_json({'nameJa': name, 'prefecture': prefecture, 'city': city, 'officialVenueSourceUrl': url, 'rawContentHashes': hashes}) AS VARCHAR)) AS evidence_hash, CASE WHEN prefecture IS NOT NULL AND len(hashes) > 0 THEN 'approve' ELSE 'reject' END AS decision FROM j""")
def venue_proposals(spark, d):
    """Venues that orders name and nobody knows, with what is known of their places."""
    from confluo.operators import review

    k = F.col("o_orderkey")
    source = lambda x: F.struct(F.lit(x).alias("source_id"), F.col("o_custkey").cast("string").alias("source_event_id"), F.when(F.col("o_custkey") % 50 != 3, F.sha2((F.col("o_custkey") % 7).cast("string"), 256)).alias("content_hash"))
    none = F.array().cast("array<struct<source_id: string, source_event_id: string, content_hash: string>>")
    sources = F.when(k % 4 == 0, none).when(k % 4 == 1, F.array(source("s1"))).otherwise(F.array(source("s1"), source("s2")))
    own = table(spark, d, "orders").select(k.alias("id"), F.when(k % 5 != 0, F.concat(F.lit("Hall "), (F.col("o_custkey") % 50).cast("string"))).alias("venue_name"), F.array(F.when(k % 3 == 0, "unknown_venue").otherwise("missing_date")).alias("issues"), sources.alias("sources"))
    facts = table(spark, d, "nation").select(F.concat(F.lit("Hall "), "n_nationkey").alias("name"), F.col("n_name").alias("prefecture"), F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit("city "), "n_regionkey")).alias("city"), F.concat(F.lit("https://place.example/"), "n_nationkey").alias("source_url"))
    return review.venue_proposals(own, facts).select("id", "name_ja", "prefecture", "city", "n_events", "n_sources", F.size("raw_content_hashes").cast("long").alias("n_hashes"), "evidence_hash", "decision")
