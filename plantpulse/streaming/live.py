"""Streams of readings: decoding, removal of redeliveries, enrichment, KPIs, alerts, sinks.

Conforming, enrichment and alerts are the batch operators as they are; only what needs state is
written here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plantpulse.constants import KPI_KEYS
from plantpulse.functions.timing import EVENT_TIME
from plantpulse.operators.kpi import KPI_MINUTE, minute_kpi
from plantpulse.sinks.hot import READERS_MINUTES, write_hot_batch
from plantpulse.sinks.tables import upsert
from plantpulse.sources.readings import dead_letters, good_readings, parse_messages

#: How far behind the newest event a reading may arrive and still count in the stream. Later ones
#: are left to ``plans.late.replay_late``, or to the batch job, which recomputes the whole lookback.
LATENESS = "10 minutes"
CADENCE = "1 minute"

KPI_TABLE_KEYS = (KPI_MINUTE, *KPI_KEYS)
KPI_TABLE_PARTITIONS = ("kpi_date", "kpi_hour")
ALERT_TABLE_PARTITIONS = ("alert_date", "alert_hour")


def without_redeliveries(readings: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each identity once, as long as its copies arrive within ``lateness``; state is bounded by it.

    Rows without identity are no copies of each other and pass as they are. Of rows whose time does not parse copies are
    dropped within a micro-batch at least; they have no place in time. The result carries the watermark.
    """
    readings = readings.withWatermark(EVENT_TIME, lateness)
    known = F.col("_id").isNotNull()
    return readings.where(known).dropDuplicatesWithinWatermark(["_id"]).unionByName(readings.where(~known))


def live_minute_kpi(enriched: DataFrame, lateness: str | None = LATENESS) -> DataFrame:
    """``minute_kpi`` as a stream; minutes older than ``lateness`` leave the state.

    Run it in update mode into ``upsert_each``, so that open minutes are visible at once. ``lateness=None``: the input
    has its watermark already, as after ``without_redeliveries``; then only append mode is possible, which
    shows a minute once it is over. ``plans.jobs.live_kpi`` shows it at once, and counts late readings too.
    """
    if lateness is not None:
        enriched = enriched.withWatermark(EVENT_TIME, lateness)
    # grouped by the window itself: only that column tells Spark which groups the watermark has passed
    kpi = minute_kpi(enriched, minute=F.window(EVENT_TIME, "1 minute"))
    return kpi.withColumn(KPI_MINUTE, F.col(KPI_MINUTE)["start"])


def kpi_table_rows(kpi: DataFrame) -> DataFrame:
    return kpi.withColumns({"kpi_date": F.to_date(KPI_MINUTE), "kpi_hour": F.hour(KPI_MINUTE)})


def alert_table_rows(alerts: DataFrame) -> DataFrame:
    return alerts.withColumns({"alert_date": F.to_date("alert_time_utc"), "alert_hour": F.hour("alert_time_utc")})


def upsert_each(path: str, keys: tuple[str, ...], partitions: tuple[str, ...]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges every micro-batch into the table at ``path``.

    Merging by key makes a batch that is delivered again after a failure harmless.
    """

    def write(batch: DataFrame, _: int) -> None:
        upsert(batch.sparkSession, batch, path, keys, partitions)

    return write


def start(writer, checkpoint: str, cadence: str | None) -> StreamingQuery:
    """``cadence=None`` processes what is there and stops."""
    trigger = {"availableNow": True} if cadence is None else {"processingTime": cadence}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def store_stream(
    raw: DataFrame, path: str, checkpoint: str, cadence: str | None = CADENCE, name: str = "s0"
) -> StreamingQuery:
    """Raw readings into the hot store, by day and hour; each micro-batch is stored once.

    Batches are named by ``name`` and their number. Numbers start over with a new checkpoint, so a
    stream that gets one also needs a new name.
    """

    def write(batch: DataFrame, number: int) -> None:
        write_hot_batch(batch, path, f"{name}-{number}", keep_minutes=READERS_MINUTES)

    return start(raw.writeStream.outputMode("append").foreachBatch(write), checkpoint, cadence)


def store_messages(
    records: DataFrame, path: str, dead: str, checkpoint: str, cadence: str | None = CADENCE, name: str = "s0"
) -> StreamingQuery:
    """Messages of a topic into the hot store, as ``store_stream``, and those that lost something into the table ``dead``.

    The dead letters of a micro-batch have a folder of their own, which a repeated batch replaces. They are written first: once a
    batch shows in the hot store, its dead letters are there.
    """

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_messages(batch).persist(StorageLevel.MEMORY_AND_DISK)
        label = f"{name}-{number}"
        try:
            dead_letters(parsed).write.mode("overwrite").parquet(f"{dead}/ingest_batch={label}")
            write_hot_batch(good_readings(parsed), path, label, keep_minutes=READERS_MINUTES)
        finally:
            parsed.unpersist()

    return start(records.writeStream.outputMode("append").foreachBatch(write), checkpoint, cadence)


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows that the stateful steps of ``query`` have left out as too late, over the progress it remembers."""
    steps = [s for p in query.recentProgress for s in p["stateOperators"]]
    return sum(s["numRowsDroppedByWatermark"] for s in steps)


def append_stream(rows: DataFrame, path: str, checkpoint: str, cadence: str | None = CADENCE) -> StreamingQuery:
    """Rows of a stateless stream into a Parquet folder."""
    writer = rows.writeStream.format("parquet").option("path", path).outputMode("append")
    return start(writer, checkpoint, cadence)


def kpi_stream(
    enriched: DataFrame,
    path: str,
    checkpoint: str,
    cadence: str | None = CADENCE,
    lateness: str | None = LATENESS,
) -> StreamingQuery:
    """Per-minute KPIs, kept up to date in the table at ``path``; ``lateness`` as in ``live_minute_kpi``."""
    rows = kpi_table_rows(live_minute_kpi(enriched, lateness))
    writer = rows.writeStream.outputMode("append" if lateness is None else "update").foreachBatch(
        upsert_each(path, KPI_TABLE_KEYS, KPI_TABLE_PARTITIONS)
    )
    return start(writer, checkpoint, cadence)


def alert_stream(alerts: DataFrame, path: str, checkpoint: str, cadence: str | None = CADENCE) -> StreamingQuery:
    """Alerts (with reading identity) into the table at ``path``, each reading once."""
    writer = alert_table_rows(alerts).writeStream.outputMode("append").foreachBatch(
        upsert_each(path, ("reading_id", *ALERT_TABLE_PARTITIONS), ALERT_TABLE_PARTITIONS)
    )
    return start(writer, checkpoint, cadence)
