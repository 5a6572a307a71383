"""Dates, times and deadlines. The clock is always passed in, never read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of weekdays, Sunday first.
WEEKDAYS = ("日", "月", "火", "水", "木", "金", "土")


def iso_date(y: Column, m: Column, d: Column) -> Column:
    """yyyy-MM-dd, or null where there is no such day."""
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(), text)


def clock_time(c: Column) -> Column:
    """The first h:mm of a text as HH:mm, or null if that is no time of day."""
    h, m = F.regexp_extract(c, r"(\d{1,2}):(\d{2})", 1), F.regexp_extract(c, r"(\d{1,2}):(\d{2})", 2)
    return F.when((h != "") & (h.try_cast("int") <= 23) & (m.try_cast("int") <= 59), F.concat(F.lpad(h, 2, "0"), F.lit(":"), m))


def minutes_of(c: Column) -> Column:
    return F.split_part(c, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(c, F.lit(":"), F.lit(2)).try_cast("int")


def zoned_instant(date: Column, time: Column, offset: str = "+09:00") -> Column:
    return F.try_to_timestamp(F.concat(date, F.lit("T"), time, F.lit(f":00{offset}")))


def local_date(at: Column, zone: str = "Asia/Tokyo") -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd")


def weekday(date: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in WEEKDAYS]), F.dayofweek(date))


def date_label(date: Column) -> Column:
    """M/d(weekday)."""
    return F.concat(F.month(date).cast("string"), F.lit("/"), F.dayofmonth(date).cast("string"), F.lit("("), weekday(date), F.lit(")"))


def full_date_label(date: Column) -> Column:
    """yyyy/MM/dd(weekday)."""
    return F.concat(F.date_format(date, "yyyy/MM/dd"), F.lit("("), weekday(date), F.lit(")"))


def relative_day(date: Column, today: Column) -> Column:
    n = F.datediff(date, today)
    return F.when(n == 0, "今天").when(n == 1, "明天").when(n == 2, "后天").when(n < 0, "已结束").when(n <= 60, F.concat(n.cast("string"), F.lit("天后"))).otherwise("")


def countdown(target: Column, now: Column) -> Column:
    """Days, hours and minutes until a moment, never below zero; days and hours only if there are any."""
    m = F.floor(F.greatest(F.lit(0), F.unix_millis(target) - F.unix_millis(now)) / 60_000)
    d, h = F.floor(m / 1440), F.floor(m % 1440 / 60)
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.concat_ws(" ", F.when(d > 0, part(d, " 天")), F.when(h > 0, part(h, " 小时")), part(m % 60, " 分钟"))


def deadline_group(due: Column, now: Column, zone: str = "UTC") -> Column:
    """unknown, overdue, today (in the item's zone), week or later; the first that holds."""
    same_day = local_date(due, zone) == local_date(now, zone)
    return F.when(due.isNull(), "unknown").when(due < now, "overdue").when(same_day, "today").when(due <= now + F.expr("INTERVAL 7 DAYS"), "week").otherwise("later")


def freshness_bucket(age_hours: Column) -> Column:
    """By age: null is unknown, what is no number counts as new."""
    return F.when(age_hours.isNull(), "unknown").when(F.isnan(age_hours) | (age_hours < 24), "<24h").when(age_hours < 72, "1-3d").when(age_hours <= 168, "3-7d").otherwise(">7d")


def retry_after_ms(value: Column, now: Column) -> Column:
    """What a server's Retry-After asks for: seconds, or the time until a date of HTTP, never below zero. Null if it is neither."""
    seconds = F.trim(value).try_cast("double")
    date = F.regexp_extract(value, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    at = F.try_to_timestamp(F.concat(date, F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.when(seconds >= 0, F.round(seconds * 1000).cast("long")).when(seconds.isNull() & at.isNotNull(), F.greatest(F.lit(0), F.unix_millis(at) - F.unix_millis(now)))


def retry_delay_ms(attempt: Column, asked_ms: Column, random: Column) -> Column:
    """What the server asks for, at most a minute; else half a second, doubled at each attempt after the first up to half a
    minute, times 0.75 to 1.25 by `random` (0 to 1)."""
    doubled = F.least(F.lit(30_000.0), 500.0 * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))
    jitter = 0.75 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), random)) * 0.5
    return F.coalesce(F.when(asked_ms >= 0, F.least(asked_ms, F.lit(60_000))), F.floor(doubled * jitter + 0.5)).cast("long")


def months_from(start: Column, n: int) -> Column:
    first = F.trunc(start, "MM")
    return F.transform(F.sequence(first, F.add_months(first, n - 1), F.expr("INTERVAL 1 MONTH")), lambda d: F.date_format(d, "yyyy-MM"))


def valid_local(c: Column) -> Column:
    """Whether a text is a local date and time, yyyy-MM-ddTHH:mm, of a real day."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d$") & F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def deadline_instant(local: Column, offset: str = "+09:00") -> Column:
    """The instant of a local date and time in a zone of fixed offset; null where invalid."""
    return F.when(valid_local(local), F.try_to_timestamp(F.concat(local, F.lit(f":00{offset}"))))
