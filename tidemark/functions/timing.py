"""Time helpers. All operators work on ``timestamp_ntz`` and an explicit ``as_of``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session zone is."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, ts.cast("timestamp_ntz"))


def at(value: str | dt.datetime) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def parse_instant(text: Column) -> Column:
    """ISO-8601 text (``Z``, offset, or zone-less = UTC) to a zone-less UTC timestamp; null if unreadable."""
    zoned = F.regexp_replace(text, "Z$", "+00:00")
    has_zone = zoned.rlike(r"[+-]\d\d:?\d\d$")
    pinned = F.when(has_zone, zoned).otherwise(F.concat(zoned, F.lit("+00:00")))
    as_date = text.rlike(r"^\d{4}-\d\d-\d\d$")
    full = F.when(as_date, F.concat(text, F.lit("T00:00:00+00:00"))).otherwise(pinned)
    # the epoch second is independent of the session time zone
    seconds = F.try_to_timestamp(full).cast("timestamp")
    return F.timestamp_add("MICROSECOND", F.unix_micros(seconds), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def days_between(as_of: Column, ts: Column) -> Column:
    """Whole days from ts to as_of, rounded down (also for the future)."""
    return F.floor((micros(as_of) - micros(ts)) / F.lit(float(DAY)))
