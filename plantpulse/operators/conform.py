"""From raw readings to typed ones."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.codes import clean_code
from plantpulse.functions.timing import (
    EVENT_TIME,
    RAW_TIME,
    lookback_start,
    parse_event_time,
    raw_at_or_after,
    timestamp_literal,
)
from plantpulse.schemas import DIMENSIONS, READING


def conform_readings(raw: DataFrame, *, normalise: bool = True) -> DataFrame:
    """Cast every column to its declared type and add the parsed event time.

    Bad values become NULL instead of failing the job, whatever the ANSI setting.
    ``normalise`` upper-cases and trims the machine code.
    """
    columns = {f.name: F.col(f.name).try_cast(f.dataType) for f in READING.fields}
    if normalise:
        columns["machine_id"] = clean_code(columns["machine_id"])
    return raw.select(
        *[c.alias(name) for name, c in columns.items()],
        parse_event_time(columns[RAW_TIME]).alias(EVENT_TIME),
    )


def within_lookback(
    readings: DataFrame,
    as_of: datetime | str,
    minutes: int,
    *,
    whole_minutes: bool = False,
) -> DataFrame:
    """Readings from the last ``minutes`` before ``as_of``, start included; unparsed times go.

    The text comparison repeats the condition in a form the file scan can use; the comparison of
    the parsed time decides.
    """
    start = lookback_start(as_of, minutes, whole_minutes)
    return readings.where(raw_at_or_after(start)).where(F.col(EVENT_TIME) >= timestamp_literal(start))


def conform_machines(dim: DataFrame, *, normalise: bool = True) -> DataFrame:
    """Machine -> factory lookup, one row per machine: of codes that are equal once cleaned the least factory counts."""
    machine, factory = F.col("machine_id").cast("string"), F.col("factory_id").cast("string")
    if normalise:
        machine, factory = clean_code(machine), F.trim(factory)
    rows = dim.select(machine.alias("machine_id"), factory.alias("factory_id"))
    return rows.groupBy("machine_id").agg(F.min("factory_id").alias("factory_id"))


def conform_sensors(dim: DataFrame) -> DataFrame:
    """Sensor type -> name, unit and limits."""
    wanted = ("sensor_type_id", "sensor_type_name", "typical_min", "typical_max", "unit")
    types = {f.name: f.dataType for f in DIMENSIONS["dim_sensor_type"].fields}
    return dim.select(*[F.col(c).try_cast(types[c]).alias(c) for c in wanted])
