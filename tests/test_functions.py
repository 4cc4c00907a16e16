from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantpulse.functions import timing
from plantpulse.functions.timing import archive_hours, parse_event_time, raw_at_or_after, timestamp_literal


def test_as_utc_accepts_text_naive_and_aware():
    want = datetime(2024, 1, 1, 2)
    assert timing.as_utc("2024-01-01 02:00:00") == want
    assert timing.as_utc(want) == want
    assert timing.as_utc(datetime(2024, 1, 1, 5, tzinfo=timezone(timedelta(hours=3)))) == want


def test_parse_gives_null_for_other_formats(spark):
    texts = ["2024-01-01 10:00:00", "bad", "2024-01-01", "2024-13-01 10:00:00", "2024-01-01T10:00:00", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    parsed = [r[0] for r in df.select(parse_event_time("t").cast("string")).collect()]
    assert parsed == ["2024-01-01 10:00:00"] + [None] * 6


def test_parse_does_not_fail_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert spark.createDataFrame([("x",)], "t string").where(parse_event_time("t").isNotNull()).count() == 0


def test_raw_prefilter_never_drops_what_the_exact_filter_keeps(spark):
    start = "2024-01-01 10:00:00"
    texts = ["2024-01-01 09:59:59", "2024-01-01 10:00:00", "9999-01-01 00:00:00", "+10000-01-01 00:00:00", "bad", None]
    df = spark.createDataFrame([(t,) for t in texts], "event_timestamp string")
    exact = df.where(parse_event_time("event_timestamp") >= timestamp_literal(start))
    both = exact.where(raw_at_or_after(start))
    assert sorted(exact.collect()) == sorted(both.collect())
    assert exact.count() >= 2


moments = st.datetimes(datetime(2023, 11, 1), datetime(2024, 3, 1))


@pytest.fixture(scope="module")
def hourly(spark):
    from pyspark.sql import functions as F

    hours = spark.range(24 * 121).select(
        F.timestamp_seconds(F.lit(1698796800) + F.col("id") * 3600).alias("ts")
    )
    return hours.withColumns(timing.calendar_parts("ts")).cache()


@settings(max_examples=15, deadline=None)
@given(a=moments, b=moments)
def test_archive_hours_keeps_exactly_the_hours_that_meet_the_range(hourly, a, b):
    start, end = min(a, b), max(a, b)
    if start == end:
        return
    got = {r["ts"] for r in hourly.where(archive_hours(start, end)).select(hourly["ts"].cast("string").alias("ts")).collect()}
    t, want = start.replace(minute=0, second=0, microsecond=0), set()
    while t < end:
        want.add(str(t))
        t += timedelta(hours=1)
    assert got == want
