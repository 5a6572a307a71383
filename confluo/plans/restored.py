"""Backups of customers, with sections that are whole, odd, empty or no lists; orders are events and nations artists."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluo.plans.catalogue import query, table
from confluo.sources import backups

_BODY = """CASE c_custkey % 5 WHEN 0 THEN '{"plans":[{"eventId":"e' || c_custkey || '"},{"eventId":"none"},{"eventId":"e' || c_custkey || '","x":1},7],"follows":["a1","a' || c_nationkey || '","a1",null],"trips":[{"id":"t","eventIds":["e1","gone"]},{"name":"no id"}]}'
WHEN 1 THEN '{"wants":["e' || c_custkey || '","e1","none"],"follows":[]}' WHEN 2 THEN '{"plans":"all","wants":["e1"],"trips":[]}' WHEN 3 THEN '{"follows":["nobody"],"other":1}' ELSE '{"plans":[],"wants":["e1"]}' END"""


def made(spark, d):
    events = table(spark, d, "orders").select(F.lit("event").alias("kind"), F.concat(F.lit("e"), "o_orderkey").alias("id"))
    artists = table(spark, d, "nation").select(F.lit("artist").alias("kind"), F.concat(F.lit("a"), "n_nationkey").alias("id"))
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("backup_id"), F.expr(_BODY).alias("body"))
    return backups.sections(own, events.unionByName(artists))


@query(f"""WITH c AS (SELECT c_custkey AS k, c_custkey % 5 AS m, c_nationkey AS n, c_custkey IN (SELECT o_orderkey FROM orders) AS e, 1 IN (SELECT o_orderkey FROM orders) AS e1, c_custkey <> 1 AS other FROM customer),
s AS (SELECT k, 'plans' AS section, CAST(e AS BIGINT) AS restored, 4 - CAST(e AS BIGINT) AS ignored, e AS apply, '' AS why FROM c WHERE m = 0 UNION ALL SELECT k, 'follows', CASE WHEN n = 1 THEN 1 ELSE 2 END, CASE WHEN n = 1 THEN 3 ELSE 2 END, TRUE, '' FROM c WHERE m = 0
UNION ALL SELECT k, 'trips', 1, 2 + CASE WHEN e1 THEN 0 ELSE 1 END, TRUE, '' FROM c WHERE m = 0 UNION ALL SELECT k, 'wants', CAST(e AND other AS BIGINT) + CAST(e1 AS BIGINT), 3 - CAST(e AND other AS BIGINT) - CAST(e1 AS BIGINT), (e AND other) OR e1, '' FROM c WHERE m = 1 UNION ALL SELECT k, 'follows', 0, 0, TRUE, '' FROM c WHERE m = 1
UNION ALL SELECT k, 'plans', 0, 1, FALSE, 'list' FROM c WHERE m = 2 UNION ALL SELECT k, 'trips', 0, 0, TRUE, '' FROM c WHERE m = 2 UNION ALL SELECT k, 'follows', 0, 1, FALSE, '' FROM c WHERE m = 3 UNION ALL SELECT k, 'plans', 0, 0, TRUE, '' FROM c WHERE m = 4)
SELECT k AS backup_id, section, CAST(restored AS BIGINT) AS restored, CAST(ignored AS BIGINT) AS ignored, apply, CASE WHEN why = 'list' THEN section || '{backups.NO_LIST}' WHEN NOT apply THEN '{backups.NOTHING_VALID}' END AS reason FROM s""")
def backup_sections(spark, d):
    """What of each section of each backup is restored and ignored, and whether it is applied."""
    return made(spark, d)[1]
