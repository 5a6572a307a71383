"""Queries that match and compare: keys of records, observations and events, comparison sets, action dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo.functions import text
from confluo.operators import facets, fusion, resolution, sets
from confluo.plans.catalogue import query, table

DAY = "CASE WHEN o_orderkey % 7 <> 0 THEN substr('' || o_orderdate, 1, 10) END"
_NORMAL = r"regexp_replace(lower(trim({})), '[()\[\]・･,，.。''\"\s_\-–—~〜/／\\]', '', 'g')"


@query(rf"""WITH a AS (SELECT l_orderkey, list_sort(list_distinct(list(CAST(l_suppkey AS VARCHAR)))) AS ids FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey, coalesce({DAY}, 'unknown-date') AS day, CASE WHEN o_orderkey % 3 = 0 THEN 'v' || o_custkey END AS venue_id, CASE WHEN o_orderkey % 5 <> 0 THEN c_name END AS venue_name, ids, CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment END AS first_name, o_orderpriority AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown-time' ELSE '18:00' END AS t
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN a ON l_orderkey = o_orderkey),
k AS (SELECT o_orderkey, day || '|' || coalesce(venue_id, nullif({_NORMAL.format("venue_name")}, ''), 'unknown-venue') || '|' || CASE WHEN len(ids) > 0 THEN array_to_string(ids, '+') ELSE {_NORMAL.format("coalesce(first_name, title)")} END || '|' || t AS candidate_key FROM r)
SELECT o_orderkey, candidate_key, 'evt_' || substr(sha256(candidate_key), 1, 24) AS id FROM k""")
def candidate_keys(spark, d):
    """What records of one event share, and the stable id made of it."""
    artists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("ids"))
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(artists, "o_orderkey", "left")
    when = lambda condition, value: F.when(F.expr(condition), value)
    key = fusion.candidate_key(F.expr(DAY), when("o_orderkey % 3 = 0", F.concat(F.lit("v"), "o_custkey")), when("o_orderkey % 5 <> 0", F.col("c_name")), F.col("ids"), when("o_orderkey % 2 = 0", F.col("c_mktsegment")), F.col("o_orderpriority"), when("o_orderkey % 4 <> 0", F.lit("18:00")))
    return rows.select("o_orderkey", key.alias("candidate_key")).withColumn("id", fusion.stable_id("evt_", F.col("candidate_key")))


VENUES = "CASE {0} % 9 WHEN 0 THEN 'zepphaneda' WHEN 1 THEN 'zepphanedat' WHEN 2 THEN 'budokan' WHEN 3 THEN 'nakanosunplaza' WHEN 4 THEN 'kt' WHEN 5 THEN 'clubquattro' WHEN 6 THEN 'clubquattroosaka' WHEN 7 THEN 'liquidroom' ELSE 'studiocoast' END"
ACTS = "CASE {0} % 7 WHEN 0 THEN 'sheena' WHEN 1 THEN 'yonezu' WHEN 2 THEN 'ado' WHEN 3 THEN 'adoo' WHEN 4 THEN 'perfume' WHEN 5 THEN 'quruli' ELSE 'sakanaction' END"
EVENT = f"""s_suppkey AS id, '2026-07-' || (s_nationkey + 10) AS date, {VENUES.format("s_suppkey")} AS venue_name, CASE s_suppkey % 3 WHEN 0 THEN '18:00' WHEN 1 THEN '19:00' ELSE '' END AS start_time, 'tour' || (s_suppkey % 5) AS title, array({ACTS.format("s_suppkey")}) AS artist_names"""
SEEN = f"""c_custkey AS obs_id, CASE WHEN c_custkey % 6 <> 0 THEN '2026-07-' || ((c_nationkey + c_custkey) % 25 + 10) END AS date, {VENUES.format("(c_custkey + 1)")} AS venue_name, CASE c_custkey % 2 WHEN 0 THEN '18:00' ELSE '19:00' END AS start_time, 'tour' || (c_custkey % 6) AS title, array({ACTS.format("c_custkey")}, 'guest') AS artist_names, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 90 END AS hint_id"""
_ARRAY = lambda s: s.replace("array(", "list_value(")
_OVERLAP = "CASE WHEN {0} = {1} THEN 1.0 WHEN contains({0}, {1}) OR contains({1}, {0}) THEN least(len({0}), len({1})) / greatest(len({0}), len({1})) ELSE len(list_intersect(list_distinct(string_split({0}, '')), list_distinct(string_split({1}, '')))) / greatest(len(list_distinct(string_split({0}, ''))), len(list_distinct(string_split({1}, '')))) END"


@query(f"""WITH e AS (SELECT {_ARRAY(EVENT)} FROM supplier), o AS (SELECT {_ARRAY(SEEN)} FROM customer), v AS (SELECT a.venue_name AS a, b.venue_name AS b, {_OVERLAP.format("a.venue_name", "b.venue_name")} AS share FROM (SELECT DISTINCT venue_name FROM o) a, (SELECT DISTINCT venue_name FROM e) b),
w AS (SELECT DISTINCT a.venue_name AS a, b.venue_name AS b FROM e a, e b WHERE {_OVERLAP.format("a.venue_name", "b.venue_name")} >= 0.75),
p AS (SELECT o.obs_id, e.id, o.hint_id, coalesce(o.date = e.date, FALSE) AS same_date, v.share >= 0.75 AS same_venue, o.start_time = e.start_time AS same_time, e.date AS e_date, e.venue_name AS e_venue, e.start_time AS e_time, {_OVERLAP.format("o.artist_names[1]", "e.artist_names[1]")} >= 0.75 OR {_OVERLAP.format("o.artist_names[2]", "e.artist_names[1]")} >= 0.75 AS same_artist, {_OVERLAP.format("o.title", "e.title")} >= 0.6 AS same_title
FROM o CROSS JOIN e JOIN v ON v.a = o.venue_name AND v.b = e.venue_name),
s AS (SELECT *, CASE WHEN same_date THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN same_venue THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN same_time THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN same_artist THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN same_title THEN 0.05::DOUBLE ELSE 0 END AS score FROM p),
h AS (SELECT s.obs_id, s.id, s.score FROM s JOIN (SELECT a.id, count(*) AS n FROM e a JOIN e b ON a.date = b.date JOIN w ON w.a = a.venue_name AND w.b = b.venue_name GROUP BY 1) c ON c.id = s.id WHERE s.hint_id = s.id AND s.score >= 0.65 AND (NOT (c.n > 1 AND s.e_time <> '') OR s.same_time)),
g AS (SELECT obs_id, count(*) FILTER (WHERE same_date AND same_venue) AS n_same, count(*) FILTER (WHERE same_date AND same_venue AND same_time) AS n_timed, max(id) FILTER (WHERE same_date AND same_venue) AS one, max(id) FILTER (WHERE same_date AND same_venue AND same_time) AS exact FROM s GROUP BY 1),
b AS (SELECT obs_id, arg_min(id, struct_pack(a := -score, b := id)) AS best, max(score) AS best_score FROM s WHERE score > 0 GROUP BY 1),
r AS (SELECT o.obs_id, h.id AS hint, n_same, n_timed, one, exact, best, coalesce(best_score, 0) AS best_score FROM o LEFT JOIN h USING (obs_id) LEFT JOIN g USING (obs_id) LEFT JOIN b USING (obs_id)),
c AS (SELECT *, CASE WHEN hint IS NOT NULL THEN 'source_chain_match' WHEN n_same = 1 THEN 'date_venue' WHEN n_same > 1 AND n_timed = 1 THEN 'date_venue_time' WHEN best_score >= 0.45 AND n_same > 1 THEN 'ambiguous_same_day_venue' WHEN best_score >= 0.45 THEN 'light_score' ELSE 'insufficient_evidence' END AS reason FROM r),
d AS (SELECT *, CASE reason WHEN 'source_chain_match' THEN hint WHEN 'date_venue' THEN one WHEN 'date_venue_time' THEN exact WHEN 'insufficient_evidence' THEN NULL ELSE best END AS event_id FROM c)
SELECT d.obs_id, d.event_id, CASE WHEN reason = 'insufficient_evidence' THEN 'unmatched' WHEN reason IN ('light_score', 'ambiguous_same_day_venue') THEN 'probable' ELSE 'confirmed' END AS level, reason, CASE WHEN d.event_id IS NULL THEN best_score ELSE s.score END AS score FROM d LEFT JOIN s ON s.obs_id = d.obs_id AND s.id = d.event_id""")
def matched_observations(spark, d):
    """Observations against events: hinted ones, same date and venue, same time, else the best score."""
    return resolution.match_observations(table(spark, d, "customer").selectExpr(*_columns(SEEN)), table(spark, d, "supplier").selectExpr(*_columns(EVENT)))


def _columns(selected: str) -> list[str]:
    """The items of a select list, split at commas outside of brackets."""
    out, depth = [""], 0
    for c in selected:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


TOUR = "CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey || '-' || substr('' || o_orderdate, 1, 7) END"


@query(f"""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, {TOUR} AS tour FROM orders), l AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem), q AS (SELECT * FROM o WHERE k % 20 = 0),
t AS (SELECT q.k, o.k AS other, o.day FROM q JOIN o ON q.tour = o.tour), m AS (SELECT DISTINCT q.k, o.k AS other, o.day, abs(date_diff('day', q.day, o.day)) AS apart FROM q JOIN l a ON a.k = q.k JOIN l b ON b.s = a.s JOIN o ON o.k = b.k WHERE q.tour IS NULL AND abs(date_diff('day', q.day, o.day)) <= 60),
n AS (SELECT k, other, day FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN other = k THEN 0 ELSE 1 END, apart, other) AS r FROM m) WHERE r <= 10), u AS (SELECT * FROM t UNION ALL SELECT * FROM n)
SELECT k AS o_orderkey, other, row_number() OVER (PARTITION BY k ORDER BY day, other) AS place FROM u""")
def comparison_sets(spark, d):
    """For every twentieth order: those of the same tour, else the ten nearest within 60 days that share a supplier, itself
    first; by day."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.expr(TOUR).alias("tour"))
    artists = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("artist")).distinct()
    return facets.comparison_sets(orders.filter("k % 20 = 0"), orders, artists, days=60, n=10).select(F.col("k").alias("o_orderkey"), "other", F.col("place").cast("long").alias("place"))


@query("""WITH f AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'open' WHEN 'N' THEN 'not_started' ELSE 'closed' END AS state, CASE WHEN l_quantity > 10 THEN l_shipdate + INTERVAL 10 DAY END AS end_at, CASE WHEN l_quantity > 5 THEN l_shipdate END AS start_at FROM lineitem)
SELECT l_orderkey, strftime(coalesce(min(end_at) FILTER (WHERE state = 'open'), min(start_at) FILTER (WHERE state = 'not_started')), '%Y-%m-%d') AS action_day FROM f GROUP BY 1""")
def action_dates(spark, d):
    """Per order the earliest deadline of what is open, else the earliest start of what is not."""
    state = F.when(F.col("l_returnflag") == "A", "open").when(F.col("l_returnflag") == "N", "not_started").otherwise("closed")
    end, start = F.when(F.col("l_quantity") > 10, F.col("l_shipdate") + F.expr("INTERVAL 10 DAYS")), F.when(F.col("l_quantity") > 5, F.col("l_shipdate"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.date_format(facets.action_date(state, start, end), "yyyy-MM-dd").alias("action_day"))


KNOWN = "CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 <> 0 THEN c_mktsegment END"


@query(f"SELECT c_nationkey, coalesce(string_agg(DISTINCT v, ',' ORDER BY v), '') AS known FROM (SELECT c_nationkey, nullif({KNOWN}, '') AS v FROM customer) GROUP BY 1")
def unique_known(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(sets.unique_known(F.expr(KNOWN)), ",").alias("known"))


WIDE = ("abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ")


@query("""SELECT p_partkey, regexp_replace(lower(p_name || p_brand), '[^a-z0-9#]', '', 'g') || 'すーぱー' AS normal, regexp_replace(lower(p_name || p_brand), '[^a-z0-9#]', '', 'g') || 'すぱ' AS folded FROM part""")
def folded_names(spark, d):
    """Names in full width and katakana, as they are normalised and folded."""
    name = F.concat(F.translate("p_name", *WIDE), F.lit("（"), F.col("p_brand"), F.lit("） "))
    rows = table(spark, d, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", text.normalize_name(F.concat("name", F.lit("すーぱー"))).alias("normal"), text.fold_japanese(F.concat("name", F.lit("スーパー"))).alias("folded"))