import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plantpulse.schemas import DIMENSIONS, READING  # noqa: E402
from plantpulse.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "plantpulse-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Raw readings from keyword rows; unnamed columns take ordinary values."""
    usual = {
        "_id": "1", "factory_id": "FCT999", "machine_id": "MAC1", "sensor_type_id": 1,
        "operator_id": "OPR1", "product_id": 1, "event_timestamp": "2024-01-01 10:00:00",
        "reading_value": 20.0, "is_downtime": False, "planned_downtime": False,
    }

    def readings(*rows):
        full = [{**usual, "_id": str(i), **row} for i, row in enumerate(rows, 1)]
        return spark.createDataFrame([tuple(r[c] for c in READING.names) for r in full], READING)

    return readings


@pytest.fixture(scope="session")
def dims(spark):
    """Two known machines, one machine without factory; sensor 1 allows 10 to 30, sensor 9 has no limits."""
    machine = DIMENSIONS["dim_machine"]
    filler = {f.name: None for f in machine.fields}
    machines = [
        {**filler, "machine_id": "MAC1", "factory_id": "FCT1", "criticality": "High"},
        {**filler, "machine_id": "MAC2", "factory_id": "FCT2", "criticality": "Low"},
        {**filler, "machine_id": "MAC3", "factory_id": None},
    ]
    sensors = [(1, "TEMP", "Temperature", "C", 10.0, 30.0), (9, "ODD", "Odd", "x", None, None)]
    return {
        "dim_machine": spark.createDataFrame([tuple(m[f] for f in machine.names) for m in machines], machine),
        "dim_sensor_type": spark.createDataFrame(sensors, DIMENSIONS["dim_sensor_type"]),
    }


@pytest.fixture(scope="session")
def enriched(dims):
    from plantpulse.plans.jobs import enriched_readings

    def run(raw, as_of="2024-01-01 12:00:00", lookback=6000, **options):
        return enriched_readings(raw, dims, as_of, lookback, **options)

    return run
