"""Event time: parsing, buckets, ranges."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantpulse.constants import EVENT_TIME_PATTERN, EVENT_TIME_STRFTIME

RAW_TIME = "event_timestamp"
EVENT_TIME = "event_timestamp_utc"


def as_utc(moment: datetime | str) -> datetime:
    """Naive UTC datetime from a datetime (naive means UTC) or a text in the event format."""
    if isinstance(moment, str):
        return datetime.strptime(moment, EVENT_TIME_STRFTIME)
    if moment.tzinfo is not None:
        return moment.astimezone(timezone.utc).replace(tzinfo=None)
    return moment


def event_text(moment: datetime | str) -> str:
    """``moment`` as an event text, cut to the second."""
    return as_utc(moment).strftime(EVENT_TIME_STRFTIME)


def timestamp_literal(moment: datetime | str) -> Column:
    text = as_utc(moment).strftime("%Y-%m-%d %H:%M:%S.%f+00:00")
    return F.lit(text).cast("timestamp")


def parse_event_time(raw: Column | str = RAW_TIME) -> Column:
    """Timestamp of an event text; NULL where it does not follow the format."""
    return F.try_to_timestamp(raw, F.lit(EVENT_TIME_PATTERN))


def minute_of(ts: Column | str) -> Column:
    return F.date_trunc("minute", ts)


def calendar_parts(ts: Column | str) -> dict[str, Column]:
    """Partition columns of the columnar archive."""
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
    }


def lookback_start(as_of: datetime | str, minutes: int, whole_minutes: bool = False) -> datetime:
    """Start of the lookback; ``whole_minutes`` moves it down to the start of its minute."""
    start = as_utc(as_of) - timedelta(minutes=minutes)
    return start.replace(second=0, microsecond=0) if whole_minutes else start


def raw_at_or_after(start: datetime | str, raw: str = RAW_TIME) -> Column:
    """Pre-filter on the event *text* that a file scan can evaluate from its statistics.

    The format sorts as time, except for years the parser accepts with a sign; those texts start
    below "0" and are let through, so the exact filter on the parsed time still decides.
    """
    text = F.col(raw)
    return (text >= event_text(start)) | (text < "0")


def archive_hours(start: datetime | str | None, end: datetime | str | None) -> Column:
    """Predicate on ``year, month, day, hour`` keeping the hours that meet ``[start, end)``.

    Bare comparisons of partition columns with literals, so that directories are pruned.
    """
    keep = F.lit(True)
    if start is not None:
        keep = keep & _not_before(as_utc(start))
    if end is not None:
        keep = keep & _not_after(as_utc(end) - timedelta(microseconds=1))
    return keep


def _not_before(t: datetime) -> Column:
    year, month, day, hour = (F.col(c) for c in ("year", "month", "day", "hour"))
    return (year > t.year) | (
        (year == t.year)
        & ((month > t.month) | ((month == t.month) & ((day > t.day) | ((day == t.day) & (hour >= t.hour)))))
    )


def _not_after(t: datetime) -> Column:
    year, month, day, hour = (F.col(c) for c in ("year", "month", "day", "hour"))
    return (year < t.year) | (
        (year == t.year)
        & ((month < t.month) | ((month == t.month) & ((day < t.day) | ((day == t.day) & (hour <= t.hour)))))
    )
