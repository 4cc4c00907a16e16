"""Data-quality reports: counts that show what parsing, filtering and joining lose."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.timing import EVENT_TIME, lookback_start, timestamp_literal
from plantpulse.operators.lookup import attach


def quality_report(readings: DataFrame, machines: DataFrame, as_of: datetime | str, minutes: int) -> DataFrame:
    """One row of counts, in one pass. ``readings`` are conformed and *not* yet filtered by time,
    as that filter would hide unparsed times."""
    recent = F.coalesce(F.col(EVENT_TIME) >= timestamp_literal(lookback_start(as_of, minutes)), F.lit(False))
    matched = F.col("factory_id").isNotNull()
    joined = attach(readings.drop("factory_id"), machines, "machine_id")
    return joined.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(EVENT_TIME).isNull()).alias("unparsed_time"),
        F.count_if(F.col("reading_value").isNull()).alias("missing_value"),
        F.count_if(F.isnan("reading_value")).alias("nan_value"),
        F.count_if(F.col("product_id").isNull()).alias("missing_product"),
        F.count_if(F.col("operator_id").isNull()).alias("missing_operator"),
        F.count_if(recent).alias("in_lookback"),
        F.count_if(recent & matched).alias("matched"),
        F.count_if(recent & ~matched).alias("unmatched"),
    )


def unmatched_machines(readings: DataFrame, machines: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` machine codes without a factory by number of readings; ties by code.

    Readings are counted per code before the join, so the join sees one row per code.
    """
    known = machines.where(F.col("factory_id").isNotNull()).select("machine_id")
    counted = readings.groupBy("machine_id").agg(F.count(F.lit(1)).alias("num_events"))
    missing = attach(counted, known, "machine_id", how="left_anti")
    return missing.orderBy(F.desc("num_events"), F.asc_nulls_first("machine_id")).limit(top)


def orphan_keys(readings: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Per dimension key: readings whose (non-NULL) key has no row in its dimension.

    ``dims`` maps a key column to the table holding it. The readings are scanned once for all keys and counted per
    key and value before anything is joined, whatever the skew.
    """
    def values(key: str) -> list[Column]:
        return [F.lit(key).alias("key_column"), F.col(key).cast("string").alias("value")]

    each = readings.select(F.explode(F.array(*[F.struct(*values(key)) for key in dims])).alias("k")).select("k.*")
    counted = each.where("value IS NOT NULL").groupBy("key_column", "value").agg(F.count(F.lit(1)).alias("n"))
    known = reduce(DataFrame.unionAll, [dim.select(*values(key)) for key, dim in dims.items()])
    lost = attach(counted, known, ["key_column", "value"], how="left_anti")
    none = readings.sparkSession.createDataFrame([(key, None, 0) for key in dims], lost.schema)
    return lost.unionAll(none).groupBy("key_column").agg(
        F.count("value").alias("orphan_keys"), F.sum("n").alias("orphan_events")
    )


def first_machines(machines: DataFrame, n: int = 10) -> DataFrame:
    return machines.orderBy("machine_id", "factory_id").limit(n)


def newest_readings(readings: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest readings, ties by identity."""
    return (
        readings.select("_id", "machine_id", "event_timestamp", EVENT_TIME)
        .orderBy(F.desc(EVENT_TIME), "_id")
        .limit(n)
    )


def newest_event_time(readings: DataFrame) -> DataFrame:
    """The newest parsed event time, one row. A text that is no time never counts as newest."""
    return readings.agg(F.max(EVENT_TIME).alias("max_event_ts"))
