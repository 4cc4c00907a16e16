"""From the result tables to a relational warehouse."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.functions.timing import as_utc, timestamp_literal
from plantpulse.operators.kpi import KPI_MINUTE
from plantpulse.operators.star import between
from plantpulse.session import scratch
from plantpulse.sinks.tables import new_rows, recover, upsert
from plantpulse.sources.warehouse import Warehouse


def read_kpi_table(
    spark: SparkSession, path: str, start: datetime | str | None = None, end: datetime | str | None = None
) -> DataFrame:
    """KPI rows of ``[start, end)`` from the stored table; only the days in the range are read."""
    recover(spark, path)
    table = spark.read.parquet(path)
    if start is not None:
        table = table.where(F.col("kpi_date") >= F.lit(as_utc(start).date()))
    if end is not None:
        table = table.where(F.col("kpi_date") <= F.lit(as_utc(end).date()))
    return between(table, start, end).drop("kpi_date", "kpi_hour")


def publish_replacing(kpi: DataFrame, warehouse: Warehouse, table: str = "minute_kpi") -> None:
    """Make the warehouse table hold exactly ``kpi``."""
    warehouse.replace(kpi, table)


def publish_new(
    spark: SparkSession,
    rows: DataFrame,
    warehouse: Warehouse,
    table: str,
    ledger: str,
    keys: Sequence[str],
    partitions: Sequence[str],
) -> int:
    """Append those of ``rows`` that were not published before; returns how many.

    ``ledger`` is a Parquet table of the keys sent so far, so repeated runs over an overlapping
    lookback append nothing twice. It is written after the warehouse: a run that dies in between
    sends its rows again.
    """
    names = [c for c in rows.columns if c not in partitions]
    with scratch(spark, "publish") as staged:
        new_rows(spark, rows, ledger, keys, partitions).write.parquet(staged)
        fresh = spark.read.schema(rows.schema).parquet(staged)
        count = fresh.count()
        if count:
            warehouse.append(fresh.select(*names), table)
            upsert(spark, fresh, ledger, keys, partitions)
    return count


def closed_minutes(rows: DataFrame, as_of: datetime | str, minute: str = KPI_MINUTE, settle_minutes: int = 1) -> DataFrame:
    """Rows of minutes that ended at least ``settle_minutes`` before ``as_of``: an append-only
    table must not take a minute that is still filling."""
    return rows.where(F.col(minute) <= timestamp_literal(as_utc(as_of) - timedelta(minutes=settle_minutes + 1)))
