"""Days, windows and epochs."""

from __future__ import annotations

from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache
def known_zone(name: str | None) -> str:
    """The zone's name, or UTC if there's no such zone."""
    try:
        return ZoneInfo(name or "UTC").key
    except (KeyError, ValueError, OSError):
        return "UTC"


def zone_day(moment: Column, zone: str) -> Column:
    """The local day of a UTC moment."""
    return F.to_date(F.from_utc_timestamp(moment.cast("timestamp"), known_zone(zone)))


def bucket(moment: Column, seconds: int) -> Column:
    """The number of the fixed window that a moment lies in."""
    return F.floor(F.unix_micros(moment.cast("timestamp")) / (seconds * 1_000_000))


def next_month(moment: Column) -> Column:
    """Midnight on the first of the month after."""
    return F.add_months(F.trunc(moment.cast("date"), "month"), 1).cast("timestamp")


def retry_after(sent: Column, now: Column, cooldown_s: int) -> Column:
    """Whole seconds until a cooldown ends, never negative."""
    left = F.lit(cooldown_s) - (F.unix_micros(now.cast("timestamp")) - F.unix_micros(sent.cast("timestamp"))) / 1_000_000
    return F.greatest(F.lit(0), F.ceil(left)).cast("long")
