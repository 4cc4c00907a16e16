"""Readings that came too late for a stream's state, found by comparing and put right.

A stream with a watermark leaves late readings out without a trace but a count. The hot store has them: where it holds
more readings of a minute than the stream's KPI table counts, the minute is computed anew; where it holds a breach without
an alert, the alert is added.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.functions.timing import EVENT_TIME, as_utc, timestamp_literal
from plantpulse.operators.alerts import threshold_alerts
from plantpulse.operators.conform import conform_machines, conform_readings, conform_sensors
from plantpulse.operators.enrich import enrich
from plantpulse.operators.kpi import KPI_MINUTE
from plantpulse.operators.lookup import BROADCAST_BYTES
from plantpulse.plans.jobs import recompute_minutes
from plantpulse.session import scratch
from plantpulse.sinks.hot import hot_hours, open_hot
from plantpulse.sinks.tables import append, new_rows
from plantpulse.sources.readings import unique_readings
from plantpulse.streaming.live import ALERT_TABLE_PARTITIONS, alert_table_rows


@dataclass(frozen=True)
class Replayed:
    """``minutes`` whose KPIs were computed anew, ``readings`` that they had missed, ``alerts`` added."""

    minutes: int = 0
    readings: int = 0
    alerts: int = 0


def replay_late(
    spark: SparkSession,
    hot: str,
    dims: Mapping[str, DataFrame],
    out: str,
    *,
    kpi: bool = True,
    alerts: str | None = None,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
    normalise: bool = True,
    max_bytes: int = BROADCAST_BYTES,
) -> Replayed:
    """Bring the tables minute_kpi (unless ``kpi`` is False) and ``alerts`` below ``out``, which streams have written, up to
    what the hot store holds.

    Each identity counts once. ``since`` and ``until`` bound the hours that are compared; with ``until`` at the stream's
    watermark, minutes that are still open are left to it. Running again finds nothing. Both sides are counted per minute
    before they meet; only minutes that differ are read again. The streams must not write these hours meanwhile.
    """
    first, last = (None if t is None else as_utc(t) for t in (since, until))
    raw = open_hot(spark, hot).where(hot_hours(first, last) & F.col("event_date").isNotNull())
    readings = conform_readings(unique_readings(raw.drop("event_date", "event_hour", "ingest_batch")), normalise=normalise)
    if first is not None:
        readings = readings.where(F.col(EVENT_TIME) >= timestamp_literal(first))
    if last is not None:
        readings = readings.where(F.col(EVENT_TIME) < timestamp_literal(last))
    machines = conform_machines(dims["dim_machine"], normalise=normalise)
    known = enrich(readings, machines, conform_sensors(dims["dim_sensor_type"]), max_bytes=max_bytes)
    minutes = missed = added = 0
    with scratch(spark, "late") as staged:
        if kpi:
            stored = known.groupBy(F.date_trunc("minute", EVENT_TIME).alias("_minute")).agg(F.count(F.lit(1)).alias("n"))
            counted = spark.read.parquet(f"{out}/minute_kpi").groupBy(F.col(KPI_MINUTE).alias("_minute"))
            counted = counted.agg(F.sum("num_events").alias("counted"))
            short = stored.join(counted, "_minute", "left").withColumn("missed", F.col("n") - F.coalesce("counted", F.lit(0)))
            short.where("missed > 0").select("_minute", "missed").write.parquet(f"{staged}/minutes")
            found = spark.read.parquet(f"{staged}/minutes")
            minutes, missed = found.agg(F.count("_minute"), F.coalesce(F.sum("missed"), F.lit(0))).first()
            if minutes:
                recompute_minutes(spark, hot, dims, out, found.select("_minute"), normalise=normalise, max_bytes=max_bytes)
        if alerts is not None:
            keys = ("reading_id", *ALERT_TABLE_PARTITIONS)
            rows = alert_table_rows(threshold_alerts(known, "kpi", with_reading_id=True))
            new_rows(spark, rows, f"{out}/{alerts}", keys, ALERT_TABLE_PARTITIONS).write.parquet(f"{staged}/alerts")
            fresh = spark.read.schema(rows.schema).parquet(f"{staged}/alerts")
            if added := fresh.count():
                append(fresh, f"{out}/{alerts}", ALERT_TABLE_PARTITIONS)
    return Replayed(minutes, missed, added)
