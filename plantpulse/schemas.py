"""One explicit schema per table; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _table(names: str, **other: DataType) -> StructType:
    """A table of the given columns in order: strings, unless ``other`` says otherwise."""
    return StructType([StructField(n, other.get(n, StringType())) for n in names.split()])


READING = _table(
    "_id factory_id machine_id sensor_type_id operator_id product_id event_timestamp "
    "reading_value is_downtime planned_downtime",
    sensor_type_id=IntegerType(),
    product_id=IntegerType(),
    reading_value=DoubleType(),
    is_downtime=BooleanType(),
    planned_downtime=BooleanType(),
)

DIMENSIONS = {
    "dim_factory": _table("factory_id factory_name city country timezone capacity_class"),
    "dim_machine": _table(
        "machine_id machine_name line_code line_name product_family factory_id machine_type "
        "vendor install_date criticality",
        install_date=DateType(),
    ),
    "dim_operator": _table("operator_id operator_name experience_level shift_pattern factory_id"),
    "dim_product": _table(
        "product_id sku product_name category brand pack_size_g",
        product_id=IntegerType(),
        pack_size_g=IntegerType(),
    ),
    "dim_sensor_type": _table(
        "sensor_type_id sensor_type_code sensor_type_name unit typical_min typical_max",
        sensor_type_id=IntegerType(),
        typical_min=DoubleType(),
        typical_max=DoubleType(),
    ),
}

MANIFEST = _table(
    "run_id archived_at_utc source policy cutoff_str docs_archived docs_deleted "
    "min_event_timestamp max_event_timestamp data_paths",
    archived_at_utc=TimestampType(),
    docs_archived=LongType(),
    docs_deleted=LongType(),
    data_paths=ArrayType(StringType()),
)
