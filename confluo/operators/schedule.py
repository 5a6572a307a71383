"""Trips: estimated ends, conflicts, timelines, next actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions.clock import minutes_of, zoned_instant
from confluo.functions.status import LIVE_MINUTES
from confluo.operators.pairs import bucket_pairs


def estimated_end(date: Column, start: Column, override: Column) -> Column:
    """The given end (the next day if before the start), else 150 minutes after the start."""
    given = zoned_instant(date, override)
    given = F.when(minutes_of(override) < minutes_of(start), given + F.expr("INTERVAL 1 DAY")).otherwise(given)
    return F.coalesce(given, zoned_instant(date, start) + F.expr(f"INTERVAL {LIVE_MINUTES} MINUTES"))


def conflicts(events: DataFrame, legs: DataFrame) -> DataFrame:
    """(trip_id, kind, event_id, other): other is an event, or a leg that departs before the event ends.

    events: trip_id, event_id, pos, date, open_time, start_time, end_override, place, buffer_minutes. Events of one day
    meet once: in different places (cross_prefecture); the later opening before the earlier ends (overlap), or so
    little after that the buffer is missed. legs: trip_id, leg_id, depart_at (instant).
    """
    e = events.withColumns({"opens": zoned_instant(F.col("date"), F.col("open_time")), "ends": estimated_end(F.col("date"), F.col("start_time"), F.col("end_override")), "starts": zoned_instant(F.col("date"), F.col("start_time"))})
    met = bucket_pairs(e, ["trip_id", "date", "buffer_minutes"], "pos")
    swap = F.col("b_open_time") < F.col("a_open_time")
    end, opens = F.when(swap, F.col("b_ends")).otherwise(F.col("a_ends")), F.when(swap, F.col("a_opens")).otherwise(F.col("b_opens"))
    gap = F.floor((F.unix_timestamp(opens) - F.unix_timestamp(end)) / 60)
    kinds = F.array_compact(F.array(F.when(F.col("a_place") != F.col("b_place"), "cross_prefecture"), F.when(opens < end, "overlap").when(gap < F.col("buffer_minutes"), "buffer")))
    pairs = met.select("trip_id", F.explode(kinds).alias("kind"), F.col("a_event_id").alias("event_id"), F.col("b_event_id").alias("other"))
    early = e.join(legs, "trip_id").filter((F.col("depart_at") > F.col("starts")) & (F.col("depart_at") < F.col("ends")))
    return pairs.unionByName(early.select("trip_id", F.lit("return_before_end").alias("kind"), "event_id", F.col("leg_id").alias("other")))


def timeline(events: DataFrame, custom: DataFrame) -> DataFrame:
    """(trip_id, day, at, label): three moments of each event and own items, by day and time; no time comes last."""
    moments = F.explode(F.array(*[F.struct(F.col(c).alias("at"), F.lit(label).alias("label")) for c, label in (("open_time", "doors"), ("start_time", "start"), ("end_time", "end"))]))
    rows = events.select("trip_id", F.col("date").alias("day"), moments.alias("m")).select("trip_id", "day", "m.*").unionByName(custom.select("trip_id", "day", "at", "label"))
    return rows.orderBy("trip_id", "day", F.coalesce("at", F.lit("99:99")), "label")


def next_action(offers: DataFrame, now: Column) -> DataFrame:
    """Per event the next step: pay, await a result, apply while open, wait for the start; by due moment, then id."""
    label = F.when(F.col("application") == "won", "pay").when(F.col("application") == "applied", "await result").when(F.col("sale_status") == "open", "apply").when(F.col("sale_status") == "not_started", "wait for start")
    due = F.when(F.col("application") == "won", F.col("payment_deadline")).when(F.col("application") == "applied", F.col("result_at")).when(F.col("sale_status") == "open", F.col("end_at")).when(F.col("sale_status") == "not_started", F.col("start_at"))
    rows = offers.withColumns({"label": label, "due": due}).filter("label is not null")
    best = F.struct(F.col("due").isNull().alias("n"), F.col("due").alias("due"), F.col("id").alias("id"), F.col("label").alias("label"))
    return rows.groupBy("event_id").agg(F.min(best).alias("b")).select("event_id", "b.label", "b.due", F.col("b.id").alias("offer_id"), (F.col("b.due") < now).alias("overdue"))
