"""Jobs a scheduler calls. They take times, ids and paths as arguments, so a run can be repeated."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plantpulse.constants import LOOKBACK_MINUTES
from plantpulse.functions.timing import RAW_TIME, lookback_start, parse_event_time
from plantpulse.functions.thresholds import breached
from plantpulse.operators.alerts import threshold_alerts
from plantpulse.operators.conform import (
    conform_machines,
    conform_readings,
    conform_sensors,
    within_lookback,
)
from plantpulse.operators.enrich import MINUTE, enrich, with_factories, with_limits
from plantpulse.operators.kpi import KPI_MINUTE, MINUTE_LEVELS, daily_machine, minute_kpi, minute_stats_all_levels, one_level
from plantpulse.operators.lookup import BROADCAST_BYTES, measured_bytes, only_identities
from plantpulse.operators.retention import SizePolicy, age_cutoff, cutoff_before, older_than, oldest
from plantpulse.sinks.archive import append_archive, manifest, write_chunks, write_manifest, write_snapshot
from plantpulse.schemas import READING
from plantpulse.session import scratch
from plantpulse.sinks.hot import READERS_MINUTES, ReconcileError, delete_hot, hot_bytes, hot_hours, newest_second, open_hot, write_hot_batch
from plantpulse.sinks.tables import append, in_same_partitions, new_rows, swap_partitions, upsert
from plantpulse.sources.readings import read_ndjson, unique_readings, with_archived
from plantpulse.sources.snapshots import Dimensions, current
from plantpulse.streaming.live import (
    ALERT_TABLE_PARTITIONS,
    CADENCE,
    KPI_TABLE_PARTITIONS,
    alert_table_rows,
    kpi_table_rows,
    start,
)


def enriched_readings(
    raw: DataFrame,
    dims: Mapping[str, DataFrame],
    as_of: datetime | str,
    lookback: int = LOOKBACK_MINUTES,
    *,
    normalise: bool = True,
) -> DataFrame:
    """Conformed, recent, joined readings: the input of KPIs and alerts."""
    recent = within_lookback(conform_readings(raw, normalise=normalise), as_of, lookback)
    machines = conform_machines(dims["dim_machine"], normalise=normalise)
    return enrich(recent, machines, conform_sensors(dims["dim_sensor_type"]))


@dataclass(frozen=True)
class _Inputs:
    """Recent readings with limits, whole minutes only, and the machines to join them with."""

    limited: DataFrame
    machines: DataFrame
    small: bool

    def alert_rows(self, style: str) -> DataFrame:
        """Alerts; only readings in breach are joined with the machines."""
        known = with_factories(self.limited.where(breached()), self.machines, broadcast=self.small)
        return alert_table_rows(threshold_alerts(known, style, with_reading_id=True))

    def aggregate(self, operator: Callable[..., DataFrame]) -> DataFrame:
        """``operator`` over readings joined with small machines, or with large ones after grouping."""
        if self.small:
            return operator(with_factories(self.limited, self.machines, broadcast=True))
        return operator(self.limited, machines=self.machines)


def _inputs(
    raw: DataFrame,
    dims: Mapping[str, DataFrame],
    as_of: datetime | str,
    lookback: int,
    normalise: bool,
    max_bytes: int,
    archived: DataFrame | None,
) -> _Inputs:
    if {"event_date", "event_hour"} <= set(raw.columns):
        raw = raw.where(hot_hours(lookback_start(as_of, lookback, True)))
    minute = F.date_trunc("minute", parse_event_time(RAW_TIME))
    raw = with_archived(raw, archived, minute)
    recent = within_lookback(conform_readings(raw, normalise=normalise), as_of, lookback, whole_minutes=True)
    machines = conform_machines(dims["dim_machine"], normalise=normalise)
    sensors = conform_sensors(dims["dim_sensor_type"])
    size = measured_bytes({"machines": machines, "sensors": sensors})
    limited = with_limits(recent, sensors, broadcast=size["sensors"] <= max_bytes)
    return _Inputs(limited, machines, size["machines"] <= max_bytes)


def run_minute_tables(
    spark: SparkSession,
    raw: DataFrame,
    dims: Mapping[str, DataFrame],
    as_of: datetime | str,
    out: str,
    lookback: int = LOOKBACK_MINUTES,
    *,
    archived: DataFrame | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> None:
    """The four per-minute tables and the machine alert table, brought up to date below ``out``.

    The readings are scanned once for all four tables and once for the alerts. Minutes are
    recomputed and replaced whole (the lookback starts on a minute), so running again changes nothing. ``archived``:
    readings that have left ``raw`` (see ``archived_readings``), for minutes that are there only in part.
    """
    inputs = _inputs(raw, dims, as_of, lookback, True, max_bytes, archived)
    # only the aggregated rows are kept for the four writes, in memory and on disk of the executors
    levels = inputs.aggregate(minute_stats_all_levels).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for level in MINUTE_LEVELS:
            rows = one_level(levels, level).withColumn("minute_date", F.to_date(MINUTE))
            upsert(spark, rows, f"{out}/agg_{level}_minute", (MINUTE, "minute_date"), ("minute_date",))
    finally:
        levels.unpersist()
    upsert(
        spark,
        inputs.alert_rows("machine"),
        f"{out}/fact_machine_alert_events",
        ("reading_id", *ALERT_TABLE_PARTITIONS),
        ALERT_TABLE_PARTITIONS,
    )


def run_minute_kpi(
    spark: SparkSession,
    raw: DataFrame,
    dims: Mapping[str, DataFrame],
    as_of: datetime | str,
    out: str,
    lookback: int = LOOKBACK_MINUTES,
    *,
    normalise: bool = False,
    archived: DataFrame | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> None:
    """The KPI table and its alerts, brought up to date below ``out``.

    Minutes are replaced whole, so a machine that has moved leaves no old row. Only hours with recomputed minutes
    are rewritten: older KPIs stay when their readings have left the hot store. ``archived``: as in
    ``run_minute_tables``; without it, no minute of ``raw`` may have lost a part of its readings.
    """
    inputs = _inputs(raw, dims, as_of, lookback, normalise, max_bytes, archived)
    upsert(
        spark,
        kpi_table_rows(inputs.aggregate(minute_kpi)),
        f"{out}/minute_kpi",
        (KPI_MINUTE, *KPI_TABLE_PARTITIONS),
        KPI_TABLE_PARTITIONS,
    )
    upsert(
        spark,
        inputs.alert_rows("kpi"),
        f"{out}/alert_events",
        ("reading_id", *ALERT_TABLE_PARTITIONS),
        ALERT_TABLE_PARTITIONS,
    )


def update_minute_kpi(
    spark: SparkSession,
    hot: str,
    dims: Mapping[str, DataFrame],
    out: str,
    batch: DataFrame,
    *,
    normalise: bool = True,
    archived: DataFrame | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> None:
    """Recompute the KPIs of those minutes that ``batch`` (raw readings, already in the hot store) touches.

    Only the hours of these minutes are read from the store and rewritten in the table, and copies of a reading count
    once; so the cost of a batch does not grow with the store, late readings count, and a batch may come again.
    """
    minute = F.date_trunc("minute", parse_event_time(RAW_TIME))
    touched = batch.select(minute.alias("_minute")).where("_minute IS NOT NULL").distinct()
    recompute_minutes(spark, hot, dims, out, touched, normalise=normalise, archived=archived, max_bytes=max_bytes)


def recompute_minutes(
    spark: SparkSession,
    hot: str,
    dims: Mapping[str, DataFrame],
    out: str,
    minutes: DataFrame,
    *,
    normalise: bool = True,
    archived: DataFrame | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> None:
    """Replace the KPIs of ``minutes`` (one column ``_minute``, each once) by those of the hot store's readings."""
    minute = F.date_trunc("minute", parse_event_time(RAW_TIME))
    with scratch(spark, "touched") as staged:
        minutes.write.parquet(staged)
        touched = spark.read.schema(minutes.schema).parquet(staged)
        hours = touched.select(
            F.to_date("_minute").alias("event_date"), F.hour("_minute").alias("event_hour")
        ).distinct()
        recent = in_same_partitions(open_hot(spark, hot), hours, ("event_date", "event_hour"))
        recent = recent.select(*READING.fieldNames()).withColumn("_minute", minute).join(touched, "_minute", "left_semi")
        raw = unique_readings(with_archived(recent.drop("_minute"), archived, minute))
        machines = conform_machines(dims["dim_machine"], normalise=normalise)
        sensors = conform_sensors(dims["dim_sensor_type"])
        size = measured_bytes({"machines": machines, "sensors": sensors})
        limited = with_limits(
            conform_readings(raw, normalise=normalise), sensors, broadcast=size["sensors"] <= max_bytes
        )
        inputs = _Inputs(limited, machines, size["machines"] <= max_bytes)
        rows = kpi_table_rows(inputs.aggregate(minute_kpi))
        upsert(spark, rows, f"{out}/minute_kpi", (KPI_MINUTE, *KPI_TABLE_PARTITIONS), KPI_TABLE_PARTITIONS)


def live_kpi(
    raw: DataFrame,
    dims: Dimensions,
    hot: str,
    out: str,
    checkpoint: str,
    cadence: str | None = CADENCE,
    name: str = "s0",
    **options,
) -> StreamingQuery:
    """A stream of raw readings into the hot store and, minute by minute, into the KPI table below ``out``.

    ``options`` go to ``update_minute_kpi``. The stream is the only writer of that table while it runs. ``dims`` may be a
    function (see ``sources.snapshots``): every micro-batch then asks for the tables of its time, measures them again and
    broadcasts or shuffles accordingly.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)  # stored, then asked for its minutes
        try:
            write_hot_batch(batch, hot, f"{name}-{number}", keep_minutes=READERS_MINUTES)
            update_minute_kpi(batch.sparkSession, hot, current(dims), out, batch, **options)
        finally:
            batch.unpersist()

    return start(raw.writeStream.outputMode("append").foreachBatch(write), checkpoint, cadence)


def live_alerts(
    raw: DataFrame,
    dims: Dimensions,
    out: str,
    checkpoint: str,
    style: str = "kpi",
    cadence: str | None = CADENCE,
    *,
    normalise: bool = True,
    max_bytes: int = BROADCAST_BYTES,
) -> StreamingQuery:
    """A stream of raw readings into the alert table ``out``, each reading once, whenever it comes.

    Without state: a micro-batch is joined with the dimensions of its time (``dims`` as in ``live_kpi``) and compared by
    identity with the alerts of its hours. New alerts are appended; hours are not rewritten, and a batch may come again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, now = batch.sparkSession, current(dims)
        readings = conform_readings(unique_readings(batch.select(*READING.fieldNames())), normalise=normalise)
        machines, sensors = conform_machines(now["dim_machine"], normalise=normalise), conform_sensors(now["dim_sensor_type"])
        size = measured_bytes({"machines": machines, "sensors": sensors})
        limited = with_limits(readings, sensors, broadcast=size["sensors"] <= max_bytes)
        rows = _Inputs(limited, machines, size["machines"] <= max_bytes).alert_rows(style)
        with scratch(spark, "alerts") as staged:
            rows.write.parquet(f"{staged}/all")
            stored = spark.read.schema(rows.schema).parquet(f"{staged}/all")
            keys = ("reading_id", *ALERT_TABLE_PARTITIONS)
            new_rows(spark, stored, out, keys, ALERT_TABLE_PARTITIONS).write.parquet(f"{staged}/new")
            append(spark.read.schema(rows.schema).parquet(f"{staged}/new"), out, ALERT_TABLE_PARTITIONS)

    return start(raw.writeStream.outputMode("append").foreachBatch(write), checkpoint, cadence)


def run_daily(raw: DataFrame, out: str, archived: DataFrame | None = None) -> None:
    """Daily figures per machine, of the days that ``raw`` has readings of; other days stay.

    ``archived``: readings that have left ``raw``, for days that are there only in part.
    """
    day = F.to_date(parse_event_time(RAW_TIME))
    rows = daily_machine(conform_readings(with_archived(raw, archived, day), normalise=False))
    swap_partitions(rows, f"{out}/daily_machine", ("event_date",))


@dataclass(frozen=True)
class ArchiveResult:
    """What an archive run did; ``reason`` says why nothing was archived, ``docs_left`` how many candidates a
    capped run left for the next, ``size_bytes`` what the size policy measured."""

    archived: bool
    reason: str = ""
    docs_archived: int = 0
    docs_deleted: int = 0
    cutoff: str | None = None
    files: str | None = None
    docs_left: int = 0
    size_bytes: int | None = None


def reconcile(written: int, archived: int, deleted: int) -> None:
    if not written == archived == deleted:
        raise ReconcileError(f"written={written} archived={archived} deleted={deleted}")


_RECORD = "docs_archived bigint, cutoff string, files string, docs_left bigint, size_bytes bigint"


def _record_path(root: str, run_id: str, state: str) -> str:
    """Where a run notes that its files are complete (``stored``) and that it is over (``done``)."""
    return f"{root.rstrip('/')}.runs/run_id={run_id}/{state}"


def _recorded(spark: SparkSession, root: str, run_id: str, state: str) -> ArchiveResult | None:
    try:
        row = spark.read.schema(_RECORD).json(_record_path(root, run_id, state)).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    return None if row is None else ArchiveResult(True, docs_deleted=row["docs_archived"], **row.asDict())


def _record(spark: SparkSession, root: str, run_id: str, state: str, result: ArchiveResult) -> None:
    row = (result.docs_archived, result.cutoff, result.files, result.docs_left, result.size_bytes)
    spark.createDataFrame([row], _RECORD).coalesce(1).write.mode("overwrite").json(_record_path(root, run_id, state))


def run_size_archive(
    spark: SparkSession,
    hot: str,
    archive: str,
    manifests: str,
    *,
    run_id: str,
    archived_at: str,
    policy: SizePolicy,
    source: str = "sensor_readings",
) -> ArchiveResult:
    """When the hot store is larger than ``policy`` allows, move its older readings to JSON lines and describe the run.

    All candidates are taken, or the oldest up to the policy's cap, if it has one. Order: write, count what was
    written, note that the files are complete, compare counts, delete by identity, write the manifest, note that
    the run is over. So a run can be called again with its ``run_id`` at any point: before the first note it starts
    anew, between the notes it deletes what is left to delete, after the second it returns its result.
    """
    if done := _recorded(spark, archive, run_id, "done"):
        return done
    stored = _recorded(spark, archive, run_id, "stored")
    resumed = stored is not None
    if not resumed:
        size = hot_bytes(spark, hot)
        if not policy.due(size):
            return ArchiveResult(False, "below_threshold", size_bytes=size)
        readings = open_hot(spark, hot)
        cutoff = cutoff_before(newest_second(spark, hot), policy.keep_minutes)
        if cutoff is None:
            return ArchiveResult(False, "no_data", size_bytes=size)
        stored = _store(
            spark, readings, archive, run_id, cutoff, policy.run_cap, policy.chunk_docs, policy.max_chunks
        )
        stored = replace(stored, size_bytes=size)
        if not stored.archived:
            return stored
        _record(spark, archive, run_id, "stored", stored)
    result = _delete_stored(spark, hot, stored, resumed)
    row = manifest(
        spark,
        result.files,
        run_id=run_id,
        archived_at=archived_at,
        source=source,
        policy=policy.describe(),
        cutoff=result.cutoff,
        docs_deleted=result.docs_deleted,
    )
    write_manifest(row, manifests, run_id)
    _record(spark, archive, run_id, "done", result)
    return result


def run_age_dump(
    spark: SparkSession, hot: str, dumps: str, *, run_id: str, as_of: datetime | str, hours: int = 1
) -> ArchiveResult:
    """Dump all readings older than ``hours`` as JSON lines and delete them from the hot store.

    Can be called again with its ``run_id`` like ``run_size_archive``.
    """
    if done := _recorded(spark, dumps, run_id, "done"):
        return done
    stored = _recorded(spark, dumps, run_id, "stored")
    resumed = stored is not None
    if not resumed:
        stored = _store(spark, open_hot(spark, hot), dumps, run_id, age_cutoff(as_of, hours), None, 0, None)
        if not stored.archived:
            return stored
        _record(spark, dumps, run_id, "stored", stored)
    result = _delete_stored(spark, hot, stored, resumed)
    _record(spark, dumps, run_id, "done", result)
    return result


def _store(
    spark: SparkSession,
    readings: DataFrame,
    root: str,
    run_id: str,
    cutoff: str,
    cap: int | None,
    chunk_docs: int,
    max_files: int | None,
) -> ArchiveResult:
    """Write the readings before ``cutoff``, or the oldest ``cap`` of them, with all their copies."""
    # a reading without identity could not be deleted again, so it stays
    candidates = older_than(readings, cutoff).where(F.col("_id").isNotNull())
    chosen = oldest(candidates, cap) if cap is not None else candidates
    if chosen.isEmpty():
        return ArchiveResult(False, "no_older_than_cutoff", cutoff=cutoff)
    with scratch(spark, "leaving") as staged:
        # identities leave whole: what is deleted by identity later must have been written
        only_identities(readings, chosen.select("_id").distinct()).write.parquet(staged)
        leaving = spark.read.schema(readings.schema).parquet(staged)
        selected = leaving.count()
        files = write_chunks(leaving, root, run_id, chunk_docs, max_files)
    written = read_ndjson(spark, files).count()
    if written != selected:
        raise ReconcileError(f"selected={selected} written={written}; nothing deleted")
    left = 0 if cap is None else max(0, candidates.count() - written)
    return ArchiveResult(True, "", written, 0, cutoff, files, left)


def _delete_stored(spark: SparkSession, hot: str, stored: ArchiveResult, resumed: bool) -> ArchiveResult:
    """Delete what a run has stored. A first attempt must find as many rows as were written; a later one
    deletes what an earlier one has left."""
    expected = None if resumed else stored.docs_archived
    deleted = delete_hot(spark, hot, read_ndjson(spark, stored.files), expected, keep_minutes=READERS_MINUTES)
    if not resumed:
        reconcile(stored.docs_archived, stored.docs_archived, deleted)
    return replace(stored, docs_deleted=stored.docs_archived)


def run_to_parquet(spark: SparkSession, files: str | list[str], archive: str) -> bool:
    """Convert JSON lines (dumps or archive chunks) to the columnar archive; False if there are none.

    Running again on the same files adds nothing.
    """
    raw = read_ndjson(spark, files)
    if raw.isEmpty():
        return False
    append_archive(spark, raw, archive)
    return True
