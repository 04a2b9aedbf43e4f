"""Instants, day buckets and ISO text on zone-free UTC timestamps.

Everything stays ``timestamp_ntz`` so that no result depends on the session time zone.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

AsOf = str | datetime | Column | None


def moment(as_of: AsOf = None) -> Column:
    """``as_of`` as a timestamp_ntz column; the present UTC second by default."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if as_of is None:
        as_of = datetime.now(timezone.utc).replace(tzinfo=None)
    if isinstance(as_of, datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(as_of).cast("timestamp_ntz")


def window_days(days: int) -> int:
    return max(1, int(days))


def days_ago(as_of: AsOf, days: int) -> Column:
    return moment(as_of) - F.make_dt_interval(F.lit(int(days)))


def day_bucket(ts: Column) -> Column:
    return F.to_date(ts)


def to_second(ts: Column) -> Column:
    """Drop the fraction of a second, staying zone-free (``date_trunc`` would not)."""
    of_day = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.timestamp_add("SECOND", of_day, F.to_date(ts).cast("timestamp_ntz"))


def epoch_second(column: Column) -> Column:
    """Seconds since 1970 of a zone-free timestamp."""
    days = F.unix_date(F.to_date(column)) * F.lit(86400).cast("long")
    return days + F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)


def date_axis(as_of: AsOf, days: int) -> Column:
    """Array of the ``days`` calendar dates that end on the day of ``as_of``."""
    last = F.to_date(moment(as_of))
    return F.sequence(F.date_sub(last, window_days(days) - 1), last)


def iso_datetime(ts: Column, offset_minutes: int = 0) -> Column:
    """ISO-8601 text with offset; ``ts`` is UTC, shown at a fixed site offset."""
    sign = "-" if offset_minutes < 0 else "+"
    hours, minutes = divmod(abs(offset_minutes), 60)
    local = ts + F.make_dt_interval(mins=F.lit(offset_minutes)) if offset_minutes else ts
    return F.concat(
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f"{sign}{hours:02d}:{minutes:02d}")
    )
