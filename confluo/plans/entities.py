"""Entities: fusion of records, evidence, similarity, matching, deduplication, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo.functions import geometry, text
from confluo.operators import fusion, pairs, ranking, resolution, sets
from confluo.plans.catalogue import query, table
from confluo.sources import calendar


@query("""WITH r AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, o_orderstatus, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS p FROM orders)
SELECT o_custkey, month, count(*) AS members, arg_min(o_orderkey, CAST(-p AS BIGINT) * 1000000000 + o_orderkey) AS preferred_key, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS priorities,
CASE WHEN count(*) >= 2 AND bool_or(p = 3) THEN 'corroborated' WHEN bool_or(p = 3) THEN 'primary_official' ELSE 'aggregator_only' END AS evidence_level FROM r GROUP BY 1, 2""")
def fused_records(spark, d):
    """Orders of a customer and month as records of one thing; the status is the kind of source."""
    rows = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    out = fusion.fuse(rows, ["o_custkey", "month"], rank, "o_orderkey", {"o_orderpriority": "priorities"}, F.col("o_orderstatus") == "F")
    return out.select("o_custkey", "month", "members", F.col("preferred.o_orderkey").alias("preferred_key"), F.array_join("priorities", ",").alias("priorities"), "evidence_level")


@query("""WITH e AS (SELECT l_orderkey, unnest(['startTime', 'prices']) AS field, unnest(['"' || l_returnflag || '"', '[' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',1000]']) AS v, CAST(l_quantity AS BIGINT) AS q, l_linestatus, sha256(CAST(l_linenumber AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR)) AS h FROM lineitem),
p AS (SELECT l_orderkey, field, count(DISTINCT v) FILTER (WHERE l_linestatus = 'O') AS n, min(v) FILTER (WHERE l_linestatus = 'O') AS v, list_sort(list_distinct(list(q) FILTER (WHERE l_linestatus = 'O'))) AS qs, list_sort(list(h) FILTER (WHERE l_linestatus = 'O')) AS hs, list_sort(list(h) FILTER (WHERE l_linestatus = 'F')) AS others FROM e GROUP BY 1, 2),
c AS (SELECT *, '[' || array_to_string(qs, ',') || ',1000]' AS joined FROM p)
SELECT l_orderkey, field, CASE WHEN n = 0 THEN 'not_announced' WHEN n > 1 AND field = 'startTime' THEN 'conflicting_sources' ELSE 'published' END AS availability_status,
CASE WHEN n = 0 OR (n > 1 AND field = 'startTime') THEN NULL WHEN n > 1 THEN joined ELSE v END AS value_json,
CASE WHEN n > 1 AND field = 'startTime' THEN NULL WHEN n > 1 THEN sha256(joined || '|' || array_to_string(hs, '|')) WHEN n = 1 THEN sha256(array_to_string(hs, '|')) ELSE sha256(array_to_string(others, '|')) END AS approval_hash,
CASE WHEN n > 1 AND field = 'startTime' THEN 'conflict' ELSE 'pending_review' END AS approval_state FROM c""")
def field_evidence_merge(spark, d):
    """Lines of an order as evidence: a time is a scalar field, prices add up as numbers; only open lines are published."""
    q = F.col("l_quantity").cast("long").cast("string")
    fields = F.explode(F.array(F.struct(F.lit("startTime").alias("field"), F.concat(F.lit('"'), "l_returnflag", F.lit('"')).alias("value_json"), F.lit(None).cast("array<string>").alias("items")), F.struct(F.lit("prices").alias("field"), F.concat(F.lit("["), q, F.lit(",1000]")).alias("value_json"), F.array(q, F.lit("1000")).alias("items"))))
    rows = table(spark, d, "lineitem").select("l_orderkey", fields.alias("f"), F.when(F.col("l_linestatus") == "O", "published").otherwise("not_announced").alias("availability_status"), F.sha2(F.concat_ws("|", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")), 256).alias("evidence_hash"), F.lit(0.9).alias("confidence"))
    merged = fusion.merge_evidence(rows.select("l_orderkey", "f.*", "availability_status", "evidence_hash", "confidence"), ["l_orderkey"])
    return merged.select("l_orderkey", "field", "availability_status", "value_json", "approval_hash", "approval_state")


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d %H') AS slot, count(DISTINCT coalesce(CASE WHEN value > 1 THEN event_type END, '~')) AS identities, count(*) AS members FROM events GROUP BY 1, 2 HAVING count(DISTINCT coalesce(CASE WHEN value > 1 THEN event_type END, '~')) > 1""")
def slot_conflicts(spark, d):
    rows = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("slot"), F.when(F.col("value") > 1, F.col("event_type")).alias("identity"))
    return fusion.slot_conflicts(rows, ["user_id", "slot"], F.col("identity"))


@query("""WITH h AS (SELECT l_orderkey, sha256(l_linenumber || '|' || l_partkey || '|' || l_suppkey) AS h FROM lineitem) SELECT l_orderkey, sha256(string_agg(h, '|' ORDER BY h)) AS evidence_hash FROM h GROUP BY 1""")
def evidence_hash(spark, d):
    """A hash over the sorted content hashes of the records of one thing: the lines of an order."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.sha2(F.concat_ws("|", "l_linenumber", "l_partkey", "l_suppkey"), 256).alias("h"))
    return rows.groupBy("l_orderkey").agg(fusion.evidence_hash(F.collect_list("h")).alias("evidence_hash"))


@query("""WITH n AS (SELECT p_partkey, p_brand, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS s FROM part), g AS (SELECT *, list_distinct(list_transform(range(1, greatest(len(s) - 1, 1) + 1), lambda i: substr(s, i, 2))) AS b FROM n)
SELECT a.p_partkey AS a_partkey, c.p_partkey AS b_partkey, round(CASE WHEN a.s = '' OR c.s = '' THEN 0.0 WHEN a.s = c.s THEN 1.0 ELSE len(list_intersect(a.b, c.b)) / len(list_distinct(list_concat(a.b, c.b))) END, 6) AS similarity FROM g a JOIN g c ON a.p_brand = c.p_brand AND a.p_partkey < c.p_partkey
WHERE CASE WHEN a.s = '' OR c.s = '' THEN 0.0 WHEN a.s = c.s THEN 1.0 ELSE len(list_intersect(a.b, c.b)) / len(list_distinct(list_concat(a.b, c.b))) END >= 0.4""")
def bigram_similarity(spark, d):
    """Pairs of parts of a brand with alike names: names that share a rare pair of characters are compared once, and
    the parts of alike or equal names are attached to them."""
    rows = table(spark, d, "part").select("p_partkey", "p_brand", text.normalize_name(F.col("p_name"), compatible=False).alias("s"))
    rows = rows.filter("s <> ''")
    met = pairs.jaccard_candidates(rows, ["p_brand"], "s", text.bigrams(F.col("s")), (2, 5)).withColumn("similarity", text.title_similarity(F.col("a_s"), F.col("b_s"))).filter("similarity >= 0.4")
    a, b = (rows.select("p_brand", F.col("s").alias(f"{x}_s"), F.col("p_partkey").alias(f"{x}_key")) for x in "ab")
    apart = met.join(a, ["p_brand", "a_s"]).join(b, ["p_brand", "b_s"]).filter("a_key <> b_key")
    alike = apart.select(F.least("a_key", "b_key").alias("a_partkey"), F.greatest("a_key", "b_key").alias("b_partkey"), F.round("similarity", 6).alias("similarity"))
    same = pairs.bucket_pairs(rows, ["p_brand", "s"], "p_partkey")
    return alike.unionByName(same.select(F.col("a_p_partkey").alias("a_partkey"), F.col("b_p_partkey").alias("b_partkey"), F.lit(1.0).alias("similarity")))


@query("""WITH n AS (SELECT DISTINCT regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS s FROM part), q(x) AS (VALUES ('smallring'), ('redwidget'), ('ring'), ('zzz')),
p AS (SELECT x, s, list_distinct(string_split(x, '')) AS cx, list_distinct(string_split(s, '')) AS cs FROM q, n)
SELECT x AS query, s AS name, round(CASE WHEN x = s THEN 1.0 WHEN contains(x, s) OR contains(s, x) THEN least(len(x), len(s)) / greatest(len(x), len(s)) ELSE len(list_intersect(cx, cs)) / greatest(len(cx), len(cs), 1) END, 6) AS score FROM p""")
def overlap_score(spark, d):
    names = table(spark, d, "part").select(text.normalize_name(F.col("p_name"), compatible=False).alias("name")).distinct()
    asked = spark.createDataFrame([(x,) for x in ("smallring", "redwidget", "ring", "zzz")], "query string")
    return F.broadcast(asked).crossJoin(names).select("query", "name", F.round(text.overlap_score(F.col("query"), F.col("name")), 6).alias("score"))


@query("""WITH v AS (SELECT item_id, lower(regexp_extract(text, '^([^.\n]{5,})\\.', 1)) AS v FROM benchmark), m AS (SELECT doc_id, item_id, len(v) AS n FROM documents JOIN v ON contains(lower(text), v) WHERE v <> '')
SELECT doc_id, min(item_id) AS item_id FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS m FROM m) WHERE n = m GROUP BY doc_id""")
def containment_match(spark, d):
    """Documents that hold the first sentence (of five characters or more) of a benchmark item; the longest one wins. It holds
    no full stop, so whole texts are searched instead of sentences."""
    items = table(spark, d, "benchmark").select("item_id", F.lower(F.regexp_extract("text", "^([^.\n]{5,})\\.", 1)).alias("variant")).filter("variant <> ''")
    found = resolution.held(table(spark, d, "documents").select("doc_id", F.lower("text").alias("text")), "text", items)
    return found.groupBy("doc_id").agg(F.min_by("item_id", F.struct(-F.char_length("variant"), F.col("item_id"))).alias("item_id"))


@query("""WITH a(entity_id, variant) AS (VALUES (1, 'small ring'), (1, 'tiny ring'), (2, 'red widget'), (3, 'blue bolt')) SELECT p_partkey, p_name, entity_id, CASE WHEN entity_id IS NULL THEN 'unresolved' ELSE 'exact' END AS state FROM part LEFT JOIN a ON p_name = variant""")
def exact_and_unresolved(spark, d):
    variants = spark.createDataFrame([(1, "small ring"), (1, "tiny ring"), (2, "red widget"), (3, "blue bolt")], "entity_id int, variant string")
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    hit = resolution.exact(parts, "p_name", variants).withColumn("state", F.lit("exact"))
    return hit.unionByName(resolution.unresolved(parts, "p_name", variants).withColumn("entity_id", F.lit(None).cast("int")).withColumn("state", F.lit("unresolved")))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedupe_keep_first(spark, d):
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return ranking.keep_first(rows, ["h"], "doc_id").select("doc_id", "h")


@query("""WITH a AS (SELECT DISTINCT user_id, event_type, CAST(hour(ts) AS INTEGER) AS hour FROM events WHERE ts < TIMESTAMP '2024-01-16'), b AS (SELECT DISTINCT user_id, event_type, CAST(hour(ts) AS INTEGER) AS hour FROM events WHERE ts >= TIMESTAMP '2024-01-16')
SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set_difference(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.hour("ts"))
    return sets.difference(e.filter("ts < '2024-01-16'"), e.filter("ts >= '2024-01-16'"), ["user_id", "event_type", "hour"])


@query("""WITH a AS (SELECT user_id, round(sum(value), 2) AS v FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), b AS (SELECT user_id, round(sum(value), 2) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT user_id, a.v AS before, b.v AS after FROM a FULL JOIN b USING (user_id) WHERE a.v IS DISTINCT FROM b.v""")
def changed_values(spark, d):
    total = lambda where: table(spark, d, "events").filter(where).groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("v"))
    return sets.changed(total("ts < '2024-01-16'"), total("ts >= '2024-01-16'"), "user_id", "v")


@query("""WITH r AS (SELECT o_orderkey AS k, 0 AS layer, 0 AS seq, CAST(o_totalprice AS DOUBLE) AS price FROM orders UNION ALL SELECT l_orderkey, 1, l_partkey * 10 + l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey, 2, l_partkey * 10 + l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'),
m AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY layer DESC, seq DESC, price DESC) AS n FROM r) SELECT k, layer, price FROM m WHERE n = 1""")
def layered_merge(spark, d):
    """Prices by layer: the order's own, then accepted lines, then open returned ones; the last layer wins."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct((F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_extendedprice").alias("price")).alias("seq"), F.col("l_extendedprice").alias("price"), "l_returnflag", "l_linestatus")
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.struct(F.lit(0).cast("long").alias("line"), F.col("o_totalprice").alias("price")).alias("seq"), F.col("o_totalprice").alias("price"))
    return sets.layered([base, line.filter("l_returnflag = 'A'").select("k", "seq", "price"), line.filter("l_returnflag = 'R' and l_linestatus = 'O'").select("k", "seq", "price")], ["k"], "seq").select("k", "layer", "price")


@query("""WITH q(query) AS (VALUES ('smal ring'), ('red wigdet'), ('blue')), s AS (SELECT query, p_partkey, p_name, round(levenshtein(query, p_name) / greatest(len(query), len(p_name)), 6) AS distance FROM q, part), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, p_partkey) AS place FROM s WHERE distance <= 0.32)
SELECT query, p_partkey, p_name, distance, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def fuzzy_search_topk(spark, d):
    asked = spark.createDataFrame([("smal ring",), ("red wigdet",), ("blue",)], "query string")
    return resolution.fuzzy_top(asked, table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", 0.32, 5)


NAMED = "CASE p_partkey % 4 WHEN 0 THEN 'ＹＯＡ　ＳＯＢＩ（' || p_name || '）' WHEN 1 THEN 'ｽｰﾊﾟｰ' || p_name WHEN 2 THEN ' スーパー・' || p_name ELSE p_name END"


@query("""WITH p AS (SELECT p_partkey, p_partkey % 4 AS m, p_name, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS n FROM part)
SELECT p_partkey, CASE m WHEN 0 THEN 'yoasobi' WHEN 1 THEN 'スーパー' WHEN 2 THEN 'スーパー' ELSE '' END || n AS normal, CASE m WHEN 0 THEN 'yoasobi' WHEN 1 THEN 'すぱ' WHEN 2 THEN 'すぱ' ELSE '' END || n AS folded,
CASE m WHEN 0 THEN 'ｙｏａ　ｓｏｂｉ（' || lower(p_name) || '）' WHEN 1 THEN 'ｽｰﾊﾟｰ' || lower(p_name) WHEN 2 THEN 'すーぱー・' || lower(p_name) ELSE lower(trim(p_name)) END AS search FROM p""")
def normalise_names(spark, d):
    """Normal and folded forms of names in full and half width; SQL has no NFKC and so states what each becomes."""
    name = F.expr(NAMED)
    return table(spark, d, "part").select("p_partkey", text.normalize_name(name).alias("normal"), text.fold_japanese(name).alias("folded"), text.search_key(name).alias("search"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_partkey % 360 AS DOUBLE) AS x, CAST(p_size + 1 AS DOUBLE) / 100 AS s FROM part),
r AS (SELECT p_partkey, unnest([[[x + 0.001, 1.001], [x + 0.004, 1.004], [x + s, 1.0], [x + s, 1.0 + s], [x, 1.0 + s]], [[x, 5.0], [x + 0.01, 5.0], [x + 0.01, 5.01]], [[x, 7.0], [x + 0.001, 7.0], [x, 7.002]]]) AS ring FROM p),
t AS (SELECT p_partkey, list_transform(ring, lambda q: [CAST(round(q[1] * 100) AS BIGINT), CAST(round(q[2] * 100) AS BIGINT)]) AS q FROM r), u AS (SELECT p_partkey, list_filter(q, lambda v, k: k = 1 OR v <> q[k - 1]) AS q FROM t), c AS (SELECT p_partkey, CASE WHEN q[1] = q[-1] THEN q ELSE list_append(q, q[1]) END AS q FROM u),
f AS (SELECT *, (list_max(list_transform(q, lambda v: v[1])) - list_min(list_transform(q, lambda v: v[1]))) * (list_max(list_transform(q, lambda v: v[2])) - list_min(list_transform(q, lambda v: v[2]))) AS area FROM c WHERE len(q) >= 4), g AS (SELECT *, max(area) OVER (PARTITION BY p_partkey) AS most FROM f)
SELECT p_partkey, count(*) AS n, min(array_to_string(list_transform(q, lambda v: v[1] || ' ' || v[2]), ',')) AS points FROM g WHERE area >= 80 OR (most < 80 AND area = most) GROUP BY 1""")
def ring_simplify(spark, d):
    """Rings of points made of parts, simplified: the large ones, else the biggest. Points are written in hundredths."""
    x, s = (F.col("p_partkey") % 360).cast("double"), (F.col("p_size") + 1).cast("double") / 100
    ring = lambda *points: F.array(*[F.array(*[F.lit(v).cast("double") if isinstance(v, float) else v for v in p]) for p in points])
    rings = F.array(ring((x + 0.001, 1.001), (x + 0.004, 1.004), (x + s, 1.0), (x + s, s + 1.0), (x, s + 1.0)), ring((x, 5.0), (x + 0.01, 5.0), (x + 0.01, 5.01)), ring((x, 7.0), (x + 0.001, 7.0), (x, 7.002)))
    written = lambda r: F.array_join(F.transform(r, lambda p: F.concat_ws(" ", *[F.round(p[i] * 100).cast("long").cast("string") for i in (0, 1)])), ",")
    rows = table(spark, d, "part").select("p_partkey", geometry.main_rings(rings).alias("rings"))
    return rows.select("p_partkey", F.size("rings").cast("long").alias("n"), F.array_min(F.transform("rings", written)).alias("points"))


@query("""SELECT s_suppkey, i AS section, round((s_suppkey % 50 + 10) * cos(i * 2 * pi() / 12), 6) + 0.0 AS x, round((s_suppkey % 50 + 10) * sin(i * 2 * pi() / 12), 6) + 0.0 AS z, round(atan2(0.0 - sin(i * 2 * pi() / 12), 0.0 - cos(i * 2 * pi() / 12)), 6) + 0.0 AS facing FROM supplier, (SELECT CAST(unnest(range(12)) AS INTEGER) AS i)""")
def polar_ring(spark, d):
    """Twelve sections on a circle around each supplier; they face the middle at an angle above -pi, up to pi."""
    rows = table(spark, d, "supplier").select("s_suppkey", F.inline(geometry.polar_ring(12, (F.col("s_suppkey") % 50 + 10).cast("double"))))
    return rows.select("s_suppkey", "section", *[(F.col(c) + 0.0).alias(c) for c in ("x", "z", "facing")])


@query("""SELECT s_suppkey, CAST(i // 4 AS INTEGER) AS row, CAST(i % 4 AS INTEGER) AS column, round((i % 4 - 1.5::DOUBLE) * 1.25::DOUBLE, 6) AS x, round((i // 4 - 1.0::DOUBLE) * 2.5::DOUBLE, 6) AS z FROM supplier, (SELECT unnest(range(12)) AS i)""")
def seat_grid(spark, d):
    """Three rows of four sections around the middle of each supplier."""
    return table(spark, d, "supplier").select("s_suppkey", F.inline(geometry.grid(3, 4, 1.25, 2.5)))


NOTICE = "; tickets at the counter, doors open an hour before the start and close with it\\nno entry afterwards"
_ESCAPED = "replace(replace(replace(replace({0}, '\\', '\\\\'), ';', '\\;'), ',', '\\,'), chr(10), '\\n')"
_FOLDED = "CASE WHEN length({0}) <= 75 THEN {0} ELSE substr({0}, 1, 75) || chr(13) || chr(10) || ' ' || array_to_string(regexp_extract_all(substr({0}, 76), '.{{1,74}}'), chr(13) || chr(10) || ' ') END"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL 150 MINUTE AS b, 'SUMMARY:' || {_ESCAPED.format("c_name || ', ' || o_orderpriority || '" + NOTICE.replace(chr(92) + "n", "' || chr(10) || '") + "'")} AS s, 'LOCATION:' || {_ESCAPED.format("c_mktsegment")} AS l FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'order-' || o_orderkey || '@example.org' AS uid, array_to_string(['BEGIN:VEVENT', 'UID:order-' || o_orderkey || '@example.org', 'DTSTART:' || strftime(a, '%Y%m%dT%H%M%SZ'), 'DTEND:' || strftime(b, '%Y%m%dT%H%M%SZ'), {_FOLDED.format("s")}, {_FOLDED.format("l")}, 'END:VEVENT'], chr(13) || chr(10)) AS vevent FROM o""")
def ics_export(spark, d):
    """Calendar entries of orders, with long lines folded. Where all is ASCII, as here, bytes are characters and SQL can fold too."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    summary = F.concat(F.concat_ws(", ", "c_name", "o_orderpriority"), F.lit(NOTICE.replace("\\n", "\n")))
    return calendar.events(rows, F.concat(F.lit("order-"), F.col("o_orderkey"), F.lit("@example.org")), F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 150 MINUTES"), summary, F.col("c_mktsegment"))
