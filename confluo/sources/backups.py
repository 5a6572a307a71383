"""Backups read section by section: each is checked on its own, with what is restored and what is ignored.

A section that is no list, or of whose members none is valid, is not applied, so what the user has stays; an empty list is. Members are
told apart by their id: of plans and trips the last of an id counts, of follows the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Why a section is not applied.
NO_LIST, NOTHING_VALID = " 必须是数组", "非空数据段没有任何有效记录，已保留当前本机数据"
#: Sections: where the id of a member is (empty: the member itself), what it refers to, and whether the last of an id counts.
SECTIONS = {"plans": ("$.eventId", "event", True), "wants": ("", "event", True), "follows": ("", "artist", False), "trips": ("$.id", None, True)}


def members(backups: DataFrame) -> DataFrame:
    """backup_id, section, is_list, i, item: the members of each section that is there, as text; a section without any has one row
    with a null i. backups: backup_id, body. Of plans and wants only the first that is there counts."""
    keys = F.coalesce(F.json_object_keys("body"), F.array().cast("array<string>"))
    parts = F.from_json("body", ", ".join(f"{s} string" for s in SECTIONS))
    rows = backups.withColumns({"_keys": keys, "_parts": parts})
    there = lambda s: F.array_contains("_keys", s) & (~F.array_contains("_keys", "plans") if s == "wants" else F.lit(True))
    each = F.array_compact(F.array(*[F.when(there(s), F.struct(F.lit(s).alias("section"), F.col("_parts")[s].alias("text"))) for s in SECTIONS]))
    rows = rows.select("backup_id", F.explode(each).alias("s")).select("backup_id", "s.*").withColumn("is_list", F.coalesce(F.col("text").rlike(r"^\s*\["), F.lit(False)))
    items = F.when(F.col("is_list"), F.from_json("text", "array<string>"))
    return rows.select("backup_id", "section", "is_list", F.posexplode_outer(items).alias("i", "item"))


def member_id(section: Column, item: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (path, _, _) in SECTIONS.items():
        out = F.when(section == name, F.nullif(F.get_json_object(item, path) if path else item, F.lit(""))).otherwise(out)
    return out


def sections(backups: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members that are restored: backup_id, section, id, item; sections: backup_id, section, restored, ignored, apply, reason).

    known: kind (event, artist), id. Events of a trip that are not known are ignored and counted, the trip stays.
    """
    refers = F.create_map(*[F.lit(x) for name, (_, kind, _) in SECTIONS.items() if kind for x in (name, kind)])
    rows = members(backups).withColumn("id", member_id(F.col("section"), F.col("item"))).withColumn("kind", F.try_element_at(refers, F.col("section")))
    found = rows.join(known.select("kind", "id", F.lit(True).alias("_known")).distinct(), ["kind", "id"], "left")
    valid = F.col("i").isNotNull() & F.col("id").isNotNull() & (F.col("kind").isNull() | F.col("_known").isNotNull())
    last = F.col("section").isin(*[s for s, (_, _, late) in SECTIONS.items() if late])
    kept = found.filter(valid).groupBy("backup_id", "section", "id").agg(F.max_by("item", F.when(last, F.col("i")).otherwise(-F.col("i"))).alias("item"))
    inner = rows.filter((F.col("section") == "trips") & F.col("id").isNotNull()).select("backup_id", "section", F.explode(F.from_json(F.get_json_object("item", "$.eventIds"), "array<string>")).alias("id"))
    lost = inner.join(known.filter("kind = 'event'").select("id").distinct(), "id", "left_anti").groupBy("backup_id", "section").agg(F.count("*").alias("lost"))
    counts = rows.groupBy("backup_id", "section").agg(F.bool_and("is_list").alias("is_list"), F.count("i").alias("n"))
    restored = kept.groupBy("backup_id", "section").agg(F.count("*").alias("restored"))
    out = counts.join(restored, ["backup_id", "section"], "left").join(lost, ["backup_id", "section"], "left").fillna(0, ["restored", "lost"])
    apply = F.col("is_list") & ((F.col("n") == 0) | (F.col("restored") > 0))
    ignored = F.when(F.col("is_list"), F.col("n") - F.col("restored") + F.col("lost")).otherwise(1)
    reason = F.when(~F.col("is_list"), F.concat("section", F.lit(NO_LIST))).when(~apply, NOTHING_VALID)
    return kept, out.select("backup_id", "section", "restored", ignored.cast("long").alias("ignored"), apply.alias("apply"), reason.alias("reason"))
