"""Status ladders: the first branch that holds decides."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

STALE_DAYS, LIVE_MINUTES = 30, 150
#: Ranks of what is known of a field; a higher one prevails.
AVAILABILITY_RANK = {"conflicting_sources": 10, "blocked": 9, "page_fetch_failed": 8, "parser_failed": 7, "pending_review": 6, "not_checked": 5, "not_found_on_page": 4, "not_announced": 3, "source_does_not_disclose": 2, "published": 1}
#: How far each kind of source is trusted.
CONFIDENCE = {"artist_official": 1.0, "promoter_official": 0.98, "venue_official": 0.96, "ticket_official": 0.94, "official_api": 0.9, "ticket_api": 0.9}


def ranked(c: Column, ranks: dict, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), c), F.lit(default))


def availability_rank(c: Column) -> Column:
    return ranked(c, AVAILABILITY_RANK, 0)


def source_confidence(c: Column) -> Column:
    return ranked(c, CONFIDENCE, 0.7)


def phase_status(start: Column, end: Column, today: Column) -> Column:
    return F.when(end < today, "closed").when(start <= today, "open").otherwise("upcoming")


def sale_status(status: Column, start: Column, end: Column, now: Column) -> Column:
    """An ended sale is closed, a closed one stays so, else by its dates; without dates unchanged."""
    return F.when(end < now, "closed").when(status == "closed", "closed").when(start > now, "not_started").when(start <= now, "open").otherwise(status)


def is_stale(verified: Column, now: Column, days: int = STALE_DAYS) -> Column:
    """Not verified, or longer ago than `days` (exactly so many is fresh)."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(verified) > days * 86_400_000_000, F.lit(True))


def refresh_priority(status: Column, start: Column, now: Column) -> Column:
    soon = start.between(now, now + F.expr("INTERVAL 7 DAYS"))
    return F.when(status == "open", "high").when(soon, "high").when(status.isin("not_started", "unknown"), "medium").otherwise("low")


def display_status(ended: Column, sold_out: Column, resale: Column, lottery: Column, on_sale: Column) -> Column:
    off = F.lit(False)
    return F.when(F.coalesce(ended, off), "ended").when(F.coalesce(sold_out, off), "sold_out").when(F.coalesce(resale, off), "resale").when(F.coalesce(lottery, off), "lottery").when(F.coalesce(on_sale, off), "on_sale").otherwise("announced")


FESTIVAL = r"(?iu)(?:festival|フェス|fes\b)"  # a fixed pattern of titles and names


def event_type(title: Column, artist_names: Column, n_artists: Column) -> Column:
    """A festival by title or names, else by how many known artists there are."""
    said = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.array_join(F.coalesce(artist_names, F.array().cast("array<string>")), " "))
    return F.when(said.rlike(FESTIVAL), "fes").when(n_artists > 1, "taiban").otherwise("oneman")


def published_status(date: Column, hint: Column, phases: Column, today: Column) -> Column:
    """The status of an event by its phases (kind, status): ended, sold out by its source, else by the best open phase."""
    on = F.filter(F.coalesce(phases, F.array().cast("array<struct<kind:string,status:string>>")), lambda p: p["status"] == "open")
    some = lambda test: F.exists(on, lambda p: F.coalesce(test(p["kind"]), F.lit(False)))
    lottery, general, resale = (lambda k: k.endswith("lottery")), (lambda k: k == "general"), (lambda k: k == "resale")
    return display_status(date < today, hint == "sold_out", some(resale), some(lottery), some(general))


def source_family(source_type: Column) -> Column:
    """The family of a source by how its type begins, as the publishing guard counts families; of others the type itself."""
    c = F.coalesce(source_type, F.lit("unknown"))
    starts = lambda *names: c.rlike(f"^(?:{'|'.join(names)})")
    return F.when(starts("artist"), "artist").when(starts("venue"), "venue").when(starts("promoter", "organizer"), "promoter").when(starts("ticket", "playguide"), "ticket").when(c.contains("api"), "api").otherwise(c)


def coverage_family(source_type: Column) -> Column:
    """The family of a source by what its type holds, as the report of coverage counts families; none is unknown."""
    c, out = F.coalesce(source_type, F.lit("")), F.nullif(F.coalesce(source_type, F.lit("")), F.lit(""))
    for part, name in reversed((("artist", "artist"), ("venue", "venue"), ("promoter", "promoter"), ("ticket", "ticket"), ("api", "structured_api"))):
        out = F.when(c.contains(part), name).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


#: Attempts of one run, and hours until a job is looked at again by its priority, and after a failure.
ATTEMPTS, RECHECK_HOURS, RETRY_HOURS = 3, {"high": 6, "medium": 48, "low": 168}, 24


def outcome(http: Column, matched: Column, parsed: Column, attempts: Column | None = None) -> Column:
    """The next state of a fetched job. Too many requests (429) is put off while the run has attempts left, then counts as the
    client error it is; without an answer, or with a server's error, the job is put off."""
    left = F.lit(True) if attempts is None else attempts < ATTEMPTS
    refused = F.when(http.isin(401, 403), "blocked").when((http == 429) & left, "deferred").when(http.between(400, 499), "invalid")
    return refused.when((http >= 500) | http.isNull(), "deferred").when(~parsed, "deferred").when(matched, "done").otherwise("unmatched")


def next_check(status: Column, priority: Column, now: Column) -> Column:
    """When to look again: never after a refusal, a day after a failure, else by priority."""
    hours = F.when(status == "deferred", RETRY_HOURS).when(priority == "high", RECHECK_HOURS["high"]).when(priority == "medium", RECHECK_HOURS["medium"]).otherwise(RECHECK_HOURS["low"])
    return F.when(~status.isin("invalid", "blocked"), now + F.make_dt_interval(hours=hours))


def percentage(count: Column, total: Column) -> Column:
    """One decimal; 0 where there is nothing."""
    return F.coalesce(F.round(100.0 * count / F.nullif(total, F.lit(0)), 1), F.lit(0.0))


def is_unknown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")).isin("", "unknown")


def yen_in_yuan(c: Column) -> Column:
    return F.round(c.cast("decimal(14,2)") * F.lit(Decimal("0.048")), 0).cast("long")


def yen_in_dollars(c: Column) -> Column:
    return F.round(c.cast("decimal(14,2)") * F.lit(Decimal("0.0066")), 2).cast("double")
