"""Calendar (ICS) export: one VEVENT a row, lines folded at 75 bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def utc_stamp(c: Column) -> Column:
    """An instant in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")


@F.pandas_udf(StringType())
def folded(lines: pd.Series) -> pd.Series:
    """A line in parts of at most 75 bytes (74 after the first, which a space precedes), never inside a character."""

    def one(line: str | None) -> str | None:
        if line is None or len(line.encode()) <= 75:
            return line
        parts, used = [""], 0
        for c in line:
            n = len(c.encode())
            if used + n > (75 if len(parts) == 1 else 74):
                parts.append("")
                used = 0
            parts[-1] += c
            used += n
        return "\r\n ".join(parts)

    return lines.map(one)


def events(df: DataFrame, uid: Column, start: Column, end: Column, summary: Column, location: Column) -> DataFrame:
    """df's rows as (uid, vevent)."""
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART:"), utc_stamp(start)), F.concat(F.lit("DTEND:"), utc_stamp(end)), folded(F.concat(F.lit("SUMMARY:"), escaped(summary))), folded(F.concat(F.lit("LOCATION:"), escaped(location))), F.lit("END:VEVENT")]
    return df.select(uid.alias("uid"), F.concat_ws("\r\n", *lines).alias("vevent"))


def write(df: DataFrame, path: str) -> None:
    """Events as text files, one a part, each a calendar fragment."""
    df.select("vevent").write.mode("overwrite").option("lineSep", "\r\n").text(path)
