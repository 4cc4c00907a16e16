"""KPIs kept up to date from new batches alone.

Beside the KPI table lies its state: per hour, mergeable partials and a ledger of the ingest batches they were made from. A
run reads only batches of the hot store that the ledger does not have, adds their partials to those of their
hours, and writes these hours anew. Archive runs and compactions change nothing: readings that leave the store have
been counted, and rewritten folders keep their sources.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.functions.thresholds import breached
from plantpulse.functions.timing import RAW_TIME, parse_event_time
from plantpulse.operators.alerts import threshold_alerts
from plantpulse.operators.conform import conform_machines, conform_readings, conform_sensors
from plantpulse.operators.enrich import with_factories, with_limits
from plantpulse.operators.kpi import KPI_MINUTE, PARTIAL_KEYS, kpi_from_partials, kpi_partials, merged_partials
from plantpulse.operators.lookup import BROADCAST_BYTES, measured_bytes, without_identities
from plantpulse.schemas import READING
from plantpulse.session import scratch
from plantpulse.sinks import versions
from plantpulse.sinks.hot import hot_rows
from plantpulse.sinks.tables import append, new_rows, open_table, swap_partitions, upsert
from plantpulse.sinks.versions import Folder, Version
from plantpulse.sources.readings import unique_readings
from plantpulse.streaming.live import ALERT_TABLE_PARTITIONS, KPI_TABLE_PARTITIONS, alert_table_rows, kpi_table_rows

#: Partials, and one row per consumed batch with ``source_write`` and ``source_batch``.
STATE = (
    f"{KPI_MINUTE} timestamp, machine_id string, product_id int, operator_id string, sensor_type_id int, n bigint, "
    "n_value bigint, total double, least double, greatest double, planned bigint, unplanned bigint, alerts bigint, "
    "source_write string, source_batch string, kpi_date date, kpi_hour int"
)
_ALERT_KEYS = ("reading_id", *ALERT_TABLE_PARTITIONS)


@dataclass(frozen=True)
class KpiRun:
    """``version``: of the hot store that was read; ``batches``: how many parts of batches were new; ``hours``: how many hours
    were written; ``recomputed``: how many of those from all of their readings."""

    version: int | None
    batches: int = 0
    hours: int = 0
    recomputed: int = 0


def run_incremental_kpi(
    spark: SparkSession,
    hot: str,
    dims: Mapping[str, DataFrame],
    out: str,
    *,
    normalise: bool = False,
    archived: DataFrame | None = None,
    rebuild: bool = False,
    max_bytes: int = BROADCAST_BYTES,
) -> KpiRun:
    """Bring the KPI table and the alerts below ``out`` up to date with the hot store; nothing new: nothing is written.

    The tables are those of ``run_minute_kpi``, over all readings that were ever in the store while this ran, whatever their
    age. The store and the dimensions are taken as they are at the start. A batch that was delivered again with
    other files has its hours recomputed, from the store and from ``archived`` (readings that have left it, in the raw
    schema); an hour that the store has nothing of keeps its KPIs, as after an archive run. ``rebuild`` recomputes all hours the store has, for changed limits or machines; a machine that moves else changes
    factory in hours that get new readings only.

    Order: KPI hours, alerts, then the state with its ledger, each swapped in whole. A run that dies in between is
    repeated by the next with the same result. One run at a time.
    """
    base = versions.version(spark, hot)
    if base is None:
        return KpiRun(None)
    state_path = f"{out}/minute_kpi_state"
    schema = spark.createDataFrame([], STATE).schema
    state = open_table(spark, state_path, schema)
    folders = [f for f in base.rows() if f.date is not None]  # readings without time have no minute
    ledger = _ledger(state, folders)
    fresh: dict[tuple, set[tuple[str, str]]] = {}
    for f in folders:
        if new := {s for s in f.sources if rebuild or ledger.get((f.place, s[1])) != s[0]}:
            fresh.setdefault(f.place, set()).update(new)
    if not fresh:
        return KpiRun(base.number)
    whole = {p for p, sources in fresh.items() if rebuild or any((p, b) in ledger for _, b in sources)}
    # hours that a batch had readings of before it was delivered again without them
    renewed = {b: w for sources in fresh.values() for w, b in sources}
    for (place, batch), write in list(ledger.items()):
        if renewed.get(batch, write) != write:
            del ledger[place, batch]
            fresh.setdefault(place, set())
            whole.add(place)
    machines = conform_machines(dims["dim_machine"], normalise=normalise)
    sensors = conform_sensors(dims["dim_sensor_type"])
    size = measured_bytes({"machines": machines, "sensors": sensors})
    small = size["machines"] <= max_bytes

    def limited(raw: DataFrame) -> DataFrame:
        readings = conform_readings(raw.select(*READING.fieldNames()), normalise=normalise)
        return with_limits(readings, sensors, broadcast=size["sensors"] <= max_bytes)

    added = limited(_new_readings(spark, hot, base, folders, fresh, whole))
    again = limited(_all_readings(spark, hot, base, folders, whole, archived)) if whole else None
    with scratch(spark, "kpi-state") as staged:
        parts = kpi_partials(added)
        if again is not None:
            parts = parts.unionByName(kpi_partials(again))
        if state is not None and (grown := set(fresh) - whole):
            old = state.where(F.col("source_batch").isNull() & _in_hours(grown)).select(parts.columns)
            parts = parts.unionByName(old)
        kpi_table_rows(merged_partials(parts)).write.partitionBy(*KPI_TABLE_PARTITIONS).parquet(staged)
        names = [c for c in schema.fieldNames() if not c.startswith("source_")]
        merged = spark.read.schema(schema).parquet(staged).select(names)
        swap_partitions(
            kpi_table_rows(kpi_from_partials(merged.select(*PARTIAL_KEYS, *names[5:13]), machines, broadcast=small)),
            f"{out}/minute_kpi",
            KPI_TABLE_PARTITIONS,
            whole,
        )
        _write_alerts(spark, added, again, machines, small, f"{out}/alert_events")
        rows = merged.unionByName(_ledger_rows(spark, ledger, fresh), allowMissingColumns=True)
        swap_partitions(rows, state_path, KPI_TABLE_PARTITIONS, whole)
    return KpiRun(base.number, sum(map(len, fresh.values())), len(fresh), len(whole))


def _in_hours(places: set[tuple]) -> Column:
    """The partitions of some hours, so that no other is opened."""
    keep = F.lit(False)
    by_day: dict[str, list[int]] = {}
    for day, hour in places:
        by_day.setdefault(day, []).append(hour)
    for day, hours in by_day.items():
        keep = keep | ((F.col("kpi_date") == F.lit(day).cast("date")) & F.col("kpi_hour").isin(sorted(hours)))
    return keep


def _ledger(state: DataFrame | None, folders: list[Folder]) -> dict[tuple, str]:
    """(hour, batch) to the write it was consumed from, for hours the store has; a row per batch and hour."""
    places = {f.place for f in folders}
    if state is None or not places:
        return {}
    rows = state.where(F.col("source_batch").isNotNull() & _in_hours(places))
    rows = rows.select("kpi_date", "kpi_hour", "source_write", "source_batch").collect()
    return {((str(r["kpi_date"]), r["kpi_hour"]), r["source_batch"]): r["source_write"] for r in rows}


def _ledger_rows(spark: SparkSession, ledger: dict, fresh: dict) -> DataFrame:
    """The ledger of the hours that are written."""
    known = {key: write for key, write in ledger.items() if key[0] in fresh}
    known |= {(place, batch): write for place, sources in fresh.items() for write, batch in sources}
    rows = [(write, batch, day, hour) for ((day, hour), batch), write in sorted(known.items())]
    listed = spark.createDataFrame(rows, "source_write string, source_batch string, kpi_date string, kpi_hour int")
    return listed.withColumn("kpi_date", F.col("kpi_date").cast("date"))


def _new_readings(
    spark: SparkSession, hot: str, base: Version, folders: list[Folder], fresh: dict, whole: set[tuple]
) -> DataFrame:
    """Readings of new batches, but for hours that are recomputed. Folders that hold others too are filtered by batch."""
    pure, mixed = [], []
    for f in folders:
        new = set(f.sources) & fresh.get(f.place, set())
        if f.place in whole or not new:
            continue
        if new == set(f.sources):
            pure.append(f)
        else:
            mixed.append((f, {b for _, b in new}))
    rows = hot_rows(spark, hot, base, pure)
    for f, batches in mixed:
        rows = rows.unionByName(hot_rows(spark, hot, base, [f]).where(F.col("ingest_batch").isin(*sorted(batches))))
    return rows


def _all_readings(
    spark: SparkSession, hot: str, base: Version, folders: list[Folder], places: set[tuple], archived: DataFrame | None
) -> DataFrame:
    """All readings of some hours, archived ones included."""
    rows = hot_rows(spark, hot, base, [f for f in folders if f.place in places]).select(*READING.fieldNames())
    if archived is None:
        return rows
    ts = parse_event_time(RAW_TIME)
    left = archived.select(*READING.fieldNames(), F.to_date(ts).alias("kpi_date"), F.hour(ts).alias("kpi_hour"))
    left = unique_readings(left.where(_in_hours(places)).select(*READING.fieldNames()))
    return rows.unionByName(without_identities(left, rows))


def _write_alerts(
    spark: SparkSession, added: DataFrame, again: DataFrame | None, machines: DataFrame, small: bool, path: str
) -> None:
    """Alerts of new readings are appended, each once; those of recomputed hours replace their like."""

    def alerts(limited: DataFrame) -> DataFrame:
        known = with_factories(limited.where(breached()), machines, broadcast=small)
        return alert_table_rows(threshold_alerts(known, "kpi", with_reading_id=True))

    with scratch(spark, "alerts") as staged:
        alerts(added).write.parquet(staged)
        rows = spark.read.parquet(staged)
        append(new_rows(spark, rows, path, _ALERT_KEYS, ALERT_TABLE_PARTITIONS), path, ALERT_TABLE_PARTITIONS)
    if again is not None:
        upsert(spark, alerts(again), path, _ALERT_KEYS, ALERT_TABLE_PARTITIONS)
