"""Readings with the machine's factory and the sensor type's limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.timing import EVENT_TIME, minute_of
from plantpulse.operators.lookup import BROADCAST_BYTES, attach, measured_bytes

MINUTE = "minute_ts"


def with_limits(readings: DataFrame, sensors: DataFrame, *, broadcast: bool | None = None) -> DataFrame:
    """Readings with name, unit and limits of their sensor type, and the minute they fall in."""
    limited = attach(readings, sensors, "sensor_type_id", broadcast=broadcast)
    return limited.withColumn(MINUTE, minute_of(EVENT_TIME))


def with_factories(
    readings: DataFrame,
    machines: DataFrame,
    *,
    broadcast: bool | None = None,
    known_only: bool = True,
) -> DataFrame:
    """Readings with their machine's factory; the factory they carry is not reliable and goes."""
    joined = attach(readings.drop("factory_id"), machines, "machine_id", broadcast=broadcast)
    return joined.where(F.col("factory_id").isNotNull()) if known_only else joined


def enrich(
    readings: DataFrame,
    machines: DataFrame,
    sensors: DataFrame,
    *,
    max_bytes: int = BROADCAST_BYTES,
    known_only: bool = True,
) -> DataFrame:
    """Readings of known machines (or of all) with factory, limits and minute.

    Sensor types come first, so that a later filter on the limits is applied before the machines.
    """
    size = measured_bytes({"machines": machines, "sensors": sensors})
    limited = with_limits(readings, sensors, broadcast=size["sensors"] <= max_bytes)
    return with_factories(
        limited, machines, broadcast=size["machines"] <= max_bytes, known_only=known_only
    )
