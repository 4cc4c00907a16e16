"""Which readings leave the hot store, and what stays."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantpulse.constants import (
    ARCHIVE_CHUNK_DOCS,
    ARCHIVE_KEEP_MINUTES,
    ARCHIVE_POLICY_TEXT,
    ARCHIVE_THRESHOLD_MB,
    DUMP_MIN_AGE_HOURS,
    EVENT_TIME_PATTERN,
)
from plantpulse.functions.timing import RAW_TIME, as_utc, event_text, parse_event_time
from plantpulse.operators.lookup import without_identities


@dataclass(frozen=True)
class SizePolicy:
    """Archive when the hot store exceeds a size; keep its newest minutes.

    ``max_chunks`` caps each run for callers that ask for it; without it a run takes all candidates.
    """

    threshold_mb: int = ARCHIVE_THRESHOLD_MB
    keep_minutes: int = ARCHIVE_KEEP_MINUTES
    chunk_docs: int = ARCHIVE_CHUNK_DOCS
    max_chunks: int | None = None

    @property
    def run_cap(self) -> int | None:
        return None if self.max_chunks is None else self.chunk_docs * self.max_chunks

    def due(self, size_bytes: int) -> bool:
        return size_bytes > self.threshold_mb * 1024 * 1024

    def describe(self) -> str:
        return ARCHIVE_POLICY_TEXT.format(
            mb=self.threshold_mb, minutes=self.keep_minutes, docs=self.chunk_docs, chunks=self.max_chunks
        )


def newest_cutoff(hot: DataFrame, keep_minutes: int) -> str | None:
    """Event text ``keep_minutes`` before the newest event; None for a store without events.

    The clock of the events decides, not the wall clock: events may run behind it.
    """
    if {"event_date", "event_hour"} <= set(hot.columns):
        # the newest hour follows from the names of partitions; only its files are read
        (last,) = hot.where("event_date IS NOT NULL").agg(F.max(F.struct("event_date", "event_hour"))).first()
        if last is not None:
            hot = hot.where((F.col("event_date") == F.lit(last[0])) & (F.col("event_hour") == F.lit(last[1])))
    newest = F.date_format(F.max(parse_event_time(RAW_TIME)), EVENT_TIME_PATTERN)
    (text,) = hot.agg(newest).first()
    return None if text is None else event_text(as_utc(text) - timedelta(minutes=keep_minutes))


def cutoff_before(newest_second: int | None, keep_minutes: int) -> str | None:
    """``newest_cutoff`` for a newest event given in seconds since 1970."""
    if newest_second is None:
        return None
    return event_text(datetime(1970, 1, 1) + timedelta(seconds=newest_second, minutes=-keep_minutes))


def age_cutoff(as_of: datetime | str, hours: int = DUMP_MIN_AGE_HOURS) -> str:
    """Event text ``hours`` before ``as_of``."""
    return event_text(as_utc(as_of) - timedelta(hours=hours))


def older_than(hot: DataFrame, cutoff: str) -> DataFrame:
    """Readings before ``cutoff``, which itself stays. Texts are compared, as the format sorts as
    time, so the file scan can skip row groups; the store's later hours are not opened."""
    if {"event_date", "event_hour"} <= set(hot.columns):
        last = as_utc(cutoff)
        day = F.lit(last.date())
        within = (F.col("event_date") < day) | ((F.col("event_date") == day) & (F.col("event_hour") <= last.hour))
        hot = hot.where(F.col("event_date").isNull() | within)
    return hot.where(F.col(RAW_TIME) < cutoff)


def oldest(readings: DataFrame, cap: int | None) -> DataFrame:
    """The ``cap`` oldest readings by event text and identity; all of them if fewer, or without a cap. Copies
    of the last one with the same time come with it.

    Nothing is sorted as a whole: counts per hour and then per second tell in which second the cap
    falls; readings before it are all taken, and only that second's are ranked.
    """
    timed = readings.where(F.col(RAW_TIME).isNotNull())
    if cap is None:
        return timed
    hour = F.substring(RAW_TIME, 1, 13)
    full = _bucket_past(timed, hour, 0, cap)
    if full is None:
        return timed
    in_hour = timed.where(F.col(RAW_TIME).startswith(full[0]) & (hour == full[0]))
    second, before = _bucket_past(in_hour, F.col(RAW_TIME), full[1], cap)
    earlier = timed.where(F.col(RAW_TIME) < second)
    tied = timed.where(F.col(RAW_TIME) == second)
    (last,) = tied.select("_id").orderBy("_id").limit(cap - before).agg(F.max("_id")).first()
    return earlier.unionByName(tied.where(F.col("_id") <= F.lit(last)))


def _bucket_past(rows: DataFrame, bucket: Column, before: int, cap: int) -> tuple[str, int] | None:
    """The bucket in which the running count, starting at ``before``, passes ``cap``, and the count
    ahead of it. The running count is over one row per bucket, not over readings."""
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    running = counts.withColumn("upto", F.lit(before) + F.sum("n").over(Window.orderBy("bucket")))
    ahead = (F.col("upto") - F.col("n")).alias("ahead")
    hit = running.where(F.col("upto") > cap).orderBy("bucket").select("bucket", ahead).first()
    return None if hit is None else (hit["bucket"], hit["ahead"])


def remaining(hot: DataFrame, archived: DataFrame) -> DataFrame:
    """Hot readings whose identity has not been archived."""
    return without_identities(hot, archived)
