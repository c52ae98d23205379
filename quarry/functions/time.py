"""Clocks and dates of the item model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"


def instant(text: Column) -> Column:
    """Strict RFC 3339 as struct (s, ns), null where it is not one: calendar checked, -00:00 refused, nine digits at most."""
    part = lambda i: F.regexp_extract(text, RFC3339, i)
    whole = F.concat(part(1), F.when(part(3) == "Z", "+00:00").otherwise(part(3)))
    seconds = F.unix_seconds(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    ns = F.rpad(part(2), 9, "0").cast("long")
    good = text.rlike(RFC3339) & (part(3) != "-00:00") & seconds.isNotNull()
    return F.when(good, F.struct(seconds.alias("s"), ns.alias("ns")))


def calendar_date(text: Column) -> Column:
    """A date that reads back as it is written, else null."""
    read = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(read, "yyyy-MM-dd") == text), read)


def clock_seconds(text: Column) -> Column:
    """H:MM[:SS], with AM or PM for twelve hours, as seconds of the day; else null."""
    pattern = r"(?i)^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(AM|PM)?\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    hour, minute = part(1).cast("int"), part(2).cast("int")
    second = F.when(part(3) == "", 0).otherwise(part(3).cast("int"))
    half = F.upper(part(4))
    hour = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "PM", 12).otherwise(0))
    good = text.rlike(pattern) & (minute < 60) & (second < 60) & F.when(half == "", hour < 24).otherwise(part(1).cast("int").between(1, 12))
    return F.when(good, hour * 3600 + minute * 60 + second).cast("long")


def minutes_seconds(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), whole % 60)
