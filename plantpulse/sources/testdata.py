"""Readings and dimensions derived from the generic test tables.

Readings come from ``events``, machines from ``supplier``, operators from ``customer``, products
from ``part``, factories from ``nation`` and ``region``; every table is used whole. Event times are
folded into two hours so that minutes hold several readings. Some codes are written untidily, some
keys are NULL and some times do not parse, on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantpulse.constants import EVENT_TIME_PATTERN
from plantpulse.session import use_utc

AS_OF = "2024-01-01 02:00:00"
LOOKBACK = 90
FOLD_START_US = 1_704_067_200_000_000  # 2024-01-01 00:00:00
FOLD_US = 7_200_000_000
SHIFT_US = 3_600_000_000
RUN_US = 420_000_000
SENSORS = [  # id, code, name, unit, least, greatest; type 5 has no limits
    (1, "S-HEAT", "Oven heat", "degC", 3.0, 140.0),
    (2, "S-SHAKE", "Bearing shake", "um", 2.5, 150.0),
    (3, "S-LOAD", "Motor load", "kW", 2.5, 140.0),
    (4, "S-DAMP", "Dough damp", "g/kg", 2.5, 150.0),
]
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _code(prefix: str, number: str, digits: int = 10) -> str:
    return f"concat('{prefix}', lpad(string({number}), {digits}, '0'))"


def _choice(number: str, *names: str) -> str:
    """``names[number % len(names)]``."""
    listed = ", ".join(f"'{n}'" for n in names)
    return f"element_at(array({listed}), int(({number}) % {len(names)} + 1))"


def readings_from(events: DataFrame, *, fold: bool = True) -> DataFrame:
    """Raw readings from rows of ``events``, batch or stream."""
    us = "unix_micros(timestamp(ts))"
    within = f"({us} % {FOLD_US})"
    when = f"timestamp_micros({FOLD_START_US} + {within})" if fold else "timestamp(ts)"
    machine = _code("MAC", "user_id div 10 * 8")
    operator = _code("OPR", f"(user_id div 10 + {within} div {SHIFT_US}) * 125")
    return events.selectExpr(
        "string(event_id) AS _id",
        _code("FCT", "int(get_json_object(props, '$.k')) % 25", 3) + " AS factory_id",
        f"CASE WHEN event_id % 7 = 0 THEN concat(' ', lower({machine}), ' ') ELSE {machine} END AS machine_id",
        "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 "
        "WHEN 'signup' THEN 4 WHEN 'error' THEN 5 END AS sensor_type_id",
        f"CASE WHEN event_id % 97 <> 0 THEN {operator} END AS operator_id",
        f"CASE WHEN event_id % 101 <> 0 THEN int({within} div {RUN_US}) END AS product_id",
        f"CASE WHEN event_id % 211 = 0 THEN 'bad' ELSE date_format({when}, '{EVENT_TIME_PATTERN}') END "
        "AS event_timestamp",
        "value AS reading_value",
        "event_id % 33 = 0 AS is_downtime",
        "event_id % 66 = 0 AS planned_downtime",
    )


def readings(spark: SparkSession, sf_dir: str, *, fold: bool = True) -> DataFrame:
    return readings_from(table(spark, sf_dir, "events"), fold=fold)


def dim_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        _code("MAC", "s_suppkey") + " AS machine_id",
        "s_name AS machine_name",
        "concat('L', s_suppkey % 5) AS line_code",
        "concat('Line ', s_suppkey % 5) AS line_name",
        _choice("s_suppkey", "Biscuit", "Wafer", "Snack") + " AS product_family",
        _code("FCT", "s_nationkey", 3) + " AS factory_id",
        _choice("s_suppkey div 8", "Oven", "Mixer", "Cutter", "Packer") + " AS machine_type",
        _choice("s_suppkey", "North", "South") + " AS vendor",
        "date_add(DATE '2015-01-01', int(s_suppkey % 3000)) AS install_date",
        "CASE WHEN s_acctbal < 2500 THEN 'Low' WHEN s_acctbal < 7000 THEN 'Medium' ELSE 'High' END AS criticality",
    )


def dim_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).selectExpr(
        _code("FCT", "n_nationkey", 3) + " AS factory_id",
        "concat('Plant ', n_name) AS factory_name",
        "n_name AS city",
        "r_name AS country",
        "'UTC' AS timezone",
        _choice("n_nationkey", "Pilot", "Line", "Campus") + " AS capacity_class",
    )


def dim_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        _code("OPR", "c_custkey") + " AS operator_id",
        "c_name AS operator_name",
        _choice("c_custkey", "Trainee", "Skilled", "Lead") + " AS experience_level",
        _choice("c_custkey", "Early", "Late", "Night", "Mixed") + " AS shift_pattern",
        _code("FCT", "c_nationkey", 3) + " AS factory_id",
    )


def dim_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "int(p_partkey) AS product_id",
        "concat('SKU-', p_partkey) AS sku",
        "p_name AS product_name",
        "p_type AS category",
        "p_brand AS brand",
        "p_size AS pack_size_g",
    )


def dim_sensor_type(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}, '{c}', '{n}', '{u}', {lo}D, {hi}D)" for i, c, n, u, lo, hi in SENSORS)
    names = "sensor_type_id, sensor_type_code, sensor_type_name, unit, typical_min, typical_max"
    return use_utc(spark).sql(f"SELECT * FROM VALUES {rows} AS s({names})")


def dimensions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "dim_factory": dim_factory(spark, sf_dir),
        "dim_machine": dim_machine(spark, sf_dir),
        "dim_operator": dim_operator(spark, sf_dir),
        "dim_product": dim_product(spark, sf_dir),
        "dim_sensor_type": dim_sensor_type(spark),
    }
