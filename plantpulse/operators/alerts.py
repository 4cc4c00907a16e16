"""Threshold alerts: a stateless filter and projection, so also a stream operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.constants import (
    ALERT_TYPE,
    CONDITION_HIGH,
    CONDITION_LOW,
    SEVERITY_HIGH,
    SEVERITY_LOW,
)
from plantpulse.functions.thresholds import HIGH, LOW, VALUE, breached, by_side, sentence, two_places
from plantpulse.functions.timing import EVENT_TIME


def _limit() -> Column:
    return by_side(F.col(HIGH), F.col(LOW))


def _message_with_limit() -> Column:
    return sentence(
        "Sensor ", F.col("sensor_type_name"), " breached. Value=", two_places(VALUE),
        " Threshold=", two_places(_limit()), " ", F.col("unit"),
    )


def _short_message() -> Column:
    return sentence(
        "Sensor ", F.col("sensor_type_name"), " breached: ", two_places(VALUE), " ", F.col("unit")
    )


#: Per style: the identifying columns an alert carries, and its text.
STYLES = {
    "machine": (("machine_id", "sensor_type_id", "product_id"), _message_with_limit),
    "kpi": (("factory_id", "machine_id", "sensor_type_id", "product_id", "operator_id"), _short_message),
}


def threshold_alerts(enriched: DataFrame, style: str = "kpi", *, with_reading_id: bool = False) -> DataFrame:
    """One row per reading outside its sensor type's range.

    ``style`` picks the machine alert table or the one that goes with the KPI table.
    ``with_reading_id`` adds the reading's identity, which a re-runnable sink needs as its key.
    """
    who, message = STYLES[style]
    columns: dict[str, Column] = {"alert_time_utc": F.col(EVENT_TIME)}
    columns |= {name: F.col(name) for name in who}
    columns |= {
        "actual_value": F.col(VALUE),
        "threshold_value": _limit(),
        "threshold_condition": by_side(CONDITION_HIGH, CONDITION_LOW),
        "severity": by_side(SEVERITY_HIGH, SEVERITY_LOW),
        "alert_type": F.lit(ALERT_TYPE),
        "alert_message": message(),
        "resolved_flag": F.lit(False),
        "resolved_at": F.lit(None).cast("timestamp"),
    }
    if with_reading_id:
        columns["reading_id"] = F.col("_id")
    return enriched.where(breached()).select(*[c.alias(name) for name, c in columns.items()])
