"""Aggregates per minute and per day. One shuffle each, after a map-side partial aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.constants import EVENT_INTERVAL_SECONDS, KPI_KEYS
from plantpulse.functions.thresholds import breached
from plantpulse.functions.timing import EVENT_TIME
from plantpulse.operators.enrich import MINUTE, with_factories

KPI_MINUTE = "kpi_minute_start_utc"

#: Grouping columns of the four minute tables, by table suffix.
MINUTE_LEVELS = {
    "overall": (),
    "factory": ("factory_id",),
    "machine": ("factory_id", "machine_id"),
    "product": ("factory_id", "product_id"),
}


def minute_stats(enriched: DataFrame, level: str) -> DataFrame:
    """Event count and average, least and greatest value per minute at one of MINUTE_LEVELS."""
    keys = MINUTE_LEVELS[level]
    rows = enriched.where(F.col("product_id").isNotNull()) if level == "product" else enriched
    value = F.col("reading_value")
    return rows.groupBy(MINUTE, *keys).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg(value).alias("avg_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )


def minute_stats_all_levels(
    readings: DataFrame,
    levels: Sequence[str] = tuple(MINUTE_LEVELS),
    *,
    machines: DataFrame | None = None,
) -> DataFrame:
    """All ``minute_stats`` tables from one pass over the readings, told apart by ``level``.

    Readings are first reduced to partial sums at the finest grain; only those few rows are then
    expanded to the grouping sets. With ``machines``, readings are not joined with them yet: the
    partial sums are, which is the way for a machine table too large to broadcast.
    """
    grain = [MINUTE, "factory_id", "machine_id", "product_id"]
    first = grain if machines is None else [c for c in grain if c != "factory_id"]
    value = F.col("reading_value")
    partial = readings.groupBy(*first).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(value).alias("n_value"),
        F.sum(value).alias("total"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
    )
    if machines is not None:
        partial = with_factories(partial, machines, broadcast=False)
    sets = [[MINUTE, *MINUTE_LEVELS[level]] for level in levels]
    # grouping_id has one bit per grain column, set where the column is aggregated away
    ids = {sum(1 << (len(grain) - 1 - i) for i, c in enumerate(grain) if c not in s): level
           for s, level in zip(sets, levels)}
    rolled = partial.groupingSets(sets, *grain).agg(
        F.grouping_id().alias("set_id"),
        F.sum("n").alias("event_count"),
        F.try_divide(F.sum("total"), F.sum("n_value")).alias("avg_value"),
        F.min("least").alias("min_value"),
        F.max("greatest").alias("max_value"),
    )
    name = F.lit(None).cast("string")
    for set_id, level in ids.items():
        name = F.when(F.col("set_id") == set_id, level).otherwise(name)
    labelled = rolled.withColumn("level", name).drop("set_id")
    return labelled.where((F.col("level") != "product") | F.col("product_id").isNotNull())


def one_level(all_levels: DataFrame, level: str) -> DataFrame:
    """The table ``minute_stats(…, level)`` out of ``minute_stats_all_levels``."""
    return all_levels.where(F.col("level") == level).select(
        MINUTE, *MINUTE_LEVELS[level], "event_count", "avg_value", "min_value", "max_value"
    )


def _per_minute(readings: DataFrame, minute: Column | None, keys: Sequence[str]) -> DataFrame:
    value = F.col("reading_value")
    down, planned = F.col("is_downtime"), F.col("planned_downtime")
    minute = F.col(MINUTE) if minute is None else minute
    return readings.groupBy(minute.alias(KPI_MINUTE), *keys).agg(
        F.avg(value).alias("avg_reading"),
        F.max(value).alias("max_reading"),
        F.min(value).alias("min_reading"),
        F.count(F.lit(1)).alias("num_events"),
        F.count_if(down & planned).cast("int").alias("planned_downtime_sec"),
        F.count_if(down & ~planned).cast("int").alias("unplanned_downtime_sec"),
        F.count_if(breached()).alias("num_alerts"),
    )


def minute_kpi(
    readings: DataFrame,
    *,
    machines: DataFrame | None = None,
    minute: Column | None = None,
    count_null_keys: bool = True,
    downtime_estimate: bool = False,
    interval_seconds: int = EVENT_INTERVAL_SECONDS,
) -> DataFrame:
    """The KPI table: one row per minute, factory, machine, product, operator and sensor type.

    Alerts are counted in the same pass as the rest. ``count_null_keys=False`` gives the counts of
    the older rule, a join of KPIs and alert counts on plain equality, under which rows with a NULL
    key show no alerts. Downtime columns hold event counts; ``downtime_estimate`` adds seconds
    derived from them and the nominal interval between events. ``minute`` replaces the grouping
    column, for streams, which must group by a time window.

    With ``machines``, readings are not joined with them yet: as a machine has one factory, its
    groups are joined instead, and only they are shuffled for it. This is the way for a machine
    table too large to broadcast.
    """
    if machines is None:
        kpi = _per_minute(readings, minute, KPI_KEYS)
    else:
        groups = _per_minute(readings, minute, [k for k in KPI_KEYS if k != "factory_id"])
        kpi = with_factories(groups, machines, broadcast=False)
    if not count_null_keys:
        known = F.lit(True)
        for key in KPI_KEYS:
            known = known & F.col(key).isNotNull()
        kpi = kpi.withColumn("num_alerts", F.when(known, F.col("num_alerts")).otherwise(F.lit(0).cast("bigint")))
    if downtime_estimate:
        kpi = kpi.withColumns(
            {
                f"{kind}_downtime_est_sec": F.col(f"{kind}_downtime_sec") * interval_seconds
                for kind in ("planned", "unplanned")
            }
        )
    return kpi


#: Grain of ``kpi_partials``: a machine has one factory, which is joined when KPIs are read from them.
PARTIAL_KEYS = (KPI_MINUTE, *(k for k in KPI_KEYS if k != "factory_id"))
_MERGES = {
    "n": F.sum, "n_value": F.sum, "total": F.sum, "least": F.min, "greatest": F.max,
    "planned": F.sum, "unplanned": F.sum, "alerts": F.sum,
}


def kpi_partials(limited: DataFrame) -> DataFrame:
    """Sums, counts and extremes per minute, machine, product, operator and sensor type, which can be added up later."""
    value = F.col("reading_value")
    down, planned = F.col("is_downtime"), F.col("planned_downtime")
    return limited.where(F.col(MINUTE).isNotNull()).groupBy(F.col(MINUTE).alias(KPI_MINUTE), *PARTIAL_KEYS[1:]).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(value).alias("n_value"),
        F.sum(value).alias("total"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
        F.count_if(down & planned).alias("planned"),
        F.count_if(down & ~planned).alias("unplanned"),
        F.count_if(breached()).alias("alerts"),
    )


def merged_partials(partials: DataFrame) -> DataFrame:
    """Partials of the same minute and keys as one row."""
    return partials.groupBy(*PARTIAL_KEYS).agg(*[f(c).alias(c) for c, f in _MERGES.items()])


def kpi_from_partials(partials: DataFrame, machines: DataFrame, *, broadcast: bool | None = None) -> DataFrame:
    """``minute_kpi`` of the readings that merged ``partials`` were made from."""
    return with_factories(partials, machines, broadcast=broadcast).select(
        KPI_MINUTE,
        *KPI_KEYS,
        F.try_divide("total", "n_value").alias("avg_reading"),
        F.col("greatest").alias("max_reading"),
        F.col("least").alias("min_reading"),
        F.col("n").alias("num_events"),
        F.col("planned").cast("int").alias("planned_downtime_sec"),
        F.col("unplanned").cast("int").alias("unplanned_downtime_sec"),
        F.col("alerts").alias("num_alerts"),
    )


def alerts_per_minute(alerts: DataFrame) -> DataFrame:
    """Alert rows per minute and KPI key."""
    minute = F.date_trunc("minute", "alert_time_utc").alias(KPI_MINUTE)
    return alerts.groupBy(minute, *KPI_KEYS).agg(F.count(F.lit(1)).alias("num_alerts"))


def daily_machine(readings: DataFrame) -> DataFrame:
    """Average, greatest, least value and number of readings per machine and day."""
    value = F.col("reading_value")
    return readings.groupBy("machine_id", F.to_date(EVENT_TIME).alias("event_date")).agg(
        F.avg(value).alias("avg_reading"),
        F.max(value).alias("max_reading"),
        F.min(value).alias("min_reading"),
        F.count(F.lit(1)).alias("total_readings"),
    )


def freshness(kpi: DataFrame) -> DataFrame:
    """Newest minute and number of rows of a KPI table."""
    return kpi.agg(F.max(KPI_MINUTE).alias("latest_minute"), F.count(F.lit(1)).alias("rows"))
