"""Search over artists, venues and events: parts, nations and documents stand for them, and every twentieth document asks, by a
stretch of its beginning with a slip in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo.operators import search
from confluo.plans.catalogue import query, table

ARTIST = "CAST(p_partkey AS STRING) AS id, p_partkey AS seq, p_name AS name_ja, p_brand AS name_zh, upper(p_name) AS romaji, CAST(NULL AS STRING) AS kana, array(p_type, CAST(p_size AS STRING)) AS aliases"
EVENT = "CAST(doc_id AS STRING) AS id, doc_id AS seq, substring(text, 1, 40) AS title_ja, source AS title_zh, lang AS tour_name"
_ASKED = """CASE doc_id % 100 WHEN 0 THEN substring({t}, 3, 4) || 'q' || substring({t}, 8, 7) WHEN 20 THEN 'larg rd' WHEN 40 THEN 'nation' WHEN 60 THEN 'ECONOMI' ELSE ' ' || substring({t}, 1, 36) END"""


def asked(spark, d):
    return table(spark, d, "documents").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), F.expr(_ASKED.format(t="text")).alias("pattern"))


def artists(spark, d):
    return table(spark, d, "part").selectExpr(*split(ARTIST))


def venues(spark, d):
    own = table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"), "left")
    return own.selectExpr("CAST(n_nationkey AS STRING) AS id", "CAST(n_nationkey AS BIGINT) AS seq", "n_name AS name_ja", "CAST(NULL AS STRING) AS name_zh", "r_name AS city")


def events(spark, d):
    return table(spark, d, "documents").selectExpr(*split(EVENT), "array(CAST(doc_id % 50 AS STRING), CAST(doc_id % 7 AS STRING)) AS artist_ids")


def split(columns: str) -> list[str]:
    """Column expressions at the commas outside of brackets."""
    out, deep = [""], 0
    for c in columns:
        deep += (c == "(") - (c == ")")
        if c == "," and not deep:
            out.append("")
        else:
            out[-1] += c
    return out


_TRIM = r"trim(lower(coalesce({0}, '')), E' \t\n\r')"
_FIELDS = {
    "artist": (0.32, [("p_partkey", "p_name", 2 / 8.5), ("p_partkey", "p_brand", 2 / 8.5), ("p_partkey", "p_name", 1.5 / 8.5), ("p_partkey", "p_type", 1.5 / 8.5), ("p_partkey", "CAST(p_size AS VARCHAR)", 1.5 / 8.5)], "part"),
    "venue": (0.32, [("n_nationkey", "n_name", 2 / 5), ("n_nationkey", "r_name", 1 / 5)], "nation LEFT JOIN region ON n_regionkey = r_regionkey"),
    "event": (0.30, [("doc_id", "substring(text, 1, 40)", 2 / 5), ("doc_id", "source", 2 / 5), ("doc_id", "lang", 1 / 5)], "documents"),
}


def _rows() -> str:
    one = lambda kind, near, key, c, w, of: f"SELECT '{kind}' AS kind, {near} AS near, CAST({key} AS BIGINT) AS seq, {_TRIM.format(c)} AS t, {w!r} AS w FROM {of}"
    return " UNION ALL ".join(one(kind, near, key, c, w, of) for kind, (near, fields, of) in _FIELDS.items() for key, c, w in fields)


SEARCH_SQL = rf"""WITH q AS (SELECT doc_id AS query, {_TRIM.format(_ASKED.format(t="text"))} AS whole FROM documents WHERE doc_id % 20 = 0),
f AS (SELECT kind, near, seq, t, w * round(1 / sqrt(greatest(1, len(regexp_extract_all(t, '[^ ]+')))), 3) AS power FROM ({_rows()}) WHERE t <> ''),
s AS (SELECT DISTINCT whole, unnest(CASE WHEN length(whole) <= 32 THEN [whole] ELSE [substr(whole, 1, 32), substr(whole, length(whole) - 31)] END) AS p, CASE WHEN length(whole) <= 32 THEN 1 ELSE 2 END AS n FROM q WHERE whole <> ''),
x AS (SELECT DISTINCT p, t, near, CAST(floor(near * length(p) + 1e-9) AS INTEGER) AS k FROM (SELECT DISTINCT p FROM s) CROSS JOIN (SELECT DISTINCT t, near FROM f)),
e AS (SELECT p, t, near, k, CASE WHEN contains(t, p) THEN 0 ELSE list_min(list_transform(flatten(list_transform(range(1, length(t) + 1), lambda i: list_transform(range(greatest(1, length(p) - k), length(p) + k + 1), lambda m: substr(t, i, m)))), lambda u: levenshtein(u, p))) END AS errors FROM x),
h AS (SELECT s.whole, e.t, e.near, s.n, sum(greatest(0.001, errors / length(e.p))) AS total, count(*) AS hits FROM s JOIN e ON s.p = e.p WHERE errors <= k GROUP BY 1, 2, 3, 4),
m AS (SELECT q.query, f.kind, f.seq, round(exp(sum(power * ln(CASE WHEN h.t = h.whole THEN 2.220446049250313e-16 ELSE (total + h.n - hits) / h.n END))), 9) AS score FROM q JOIN h ON q.whole = h.whole JOIN f ON f.t = h.t AND f.near = h.near GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query, kind ORDER BY score, seq) AS place FROM m),
v AS (SELECT r.query, 0 AS way, place, seq FROM r WHERE kind = 'event' AND place <= 6 UNION ALL SELECT query, 1, doc_id, doc_id FROM r JOIN documents ON r.seq IN (doc_id % 50, doc_id % 7) WHERE kind = 'artist' AND place = 1),
w AS (SELECT query, seq, row_number() OVER (PARTITION BY query ORDER BY min(way), min(CASE WHEN way = 0 THEN place ELSE place + 1000000000 END)) AS place FROM v GROUP BY query, seq)
SELECT query, kind, CAST(place AS INTEGER) AS place, CAST(seq AS VARCHAR) AS id FROM r WHERE (kind = 'artist' AND place <= 5) OR (kind = 'venue' AND place <= 4) UNION ALL SELECT query, 'event', CAST(place AS INTEGER), CAST(seq AS VARCHAR) FROM w WHERE place <= 6"""


@query(SEARCH_SQL)
def global_search(spark, d):
    """Artists, venues and events for each question."""
    return search.search_all(asked(spark, d), artists(spark, d), venues(spark, d), events(spark, d))
