"""Column expressions for time buckets.

Buckets are computed on epoch seconds, so they do not depend on the session time zone. A zone argument aligns them
with that zone's wall clock. They stay stretches of real time: an hour that the clock shows twice is two buckets, one
that it skips is none, and a change of the offset within a bucket cuts it in two.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket names and their width in seconds.
WIDTHS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600}

_DAY = 86400


def width_of(bucket: str) -> int:
    """Width in seconds of a named bucket."""
    try:
        return WIDTHS[bucket]
    except KeyError:
        raise ValueError(f"unknown bucket {bucket!r}; use one of {', '.join(WIDTHS)}") from None


def start_second(ts: Column, width: int, zone: str = "UTC") -> Column:
    """Instant at which the bucket that holds ``ts`` starts, in seconds; left-closed and left-labelled."""
    return start_of(F.unix_seconds(ts), width, zone)


def start_of(second: Column, width: int, zone: str = "UTC") -> Column:
    """The same for an instant given in seconds since 1970."""
    if zone == "UTC":
        return second - F.pmod(second, F.lit(width).cast("bigint"))
    offset = offset_at(second, zone)
    start = second - F.pmod(second + offset, F.lit(width).cast("bigint"))
    # Only where the offset changed since the start of the bucket, which no change by whole buckets does.
    since = F.filter(F.sequence(start, second), lambda at: offset_at(at, zone) == offset)
    return F.when(offset_at(start, zone) == offset, start).otherwise(F.array_min(since))


def offset_at(second: Column, zone: str) -> Column:
    """Seconds by which the wall clock of a zone is ahead of UTC at an instant."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(second), zone)) - second


def wall_clock(second: Column, zone: str = "UTC") -> Column:
    """What the clock of a zone shows at an instant, as a timestamp without a zone."""
    shown = second if zone == "UTC" else second + offset_at(second, zone)
    return F.timestamp_add("SECOND", shown, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def utc_day(ts: Column) -> Column:
    """UTC calendar day of an instant."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / _DAY).cast("int"))


def instant_literal(moment: str | datetime | Column) -> Column:
    """A fixed instant as a column; text and datetimes without an offset are taken as UTC."""
    if isinstance(moment, Column):
        return moment
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return F.lit(moment)
