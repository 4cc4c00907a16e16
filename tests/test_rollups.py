"""Dashboard queries from hour and day sums equal those from the KPI table, and read less."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from plantpulse.operators.star import between, summarise
from plantpulse.plans import rollups
from plantpulse.plans.rollups import refresh_rollups, route, summarise_rolled
from plantpulse.sinks.tables import swap_partitions
from plantpulse.streaming.live import KPI_TABLE_PARTITIONS, kpi_table_rows


def kpi_rows(spark, first_hour, hours, events=3):
    """Ten KPI rows an hour from 2024-01-01 on."""
    rows = []
    for h in range(first_hour, first_hour + hours):
        for i in range(10):
            day, hour = 1 + h // 24, h % 24
            rows.append((f"2024-01-{day:02d} {hour:02d}:{i * 6:02d}:00", f"FCT{i % 2 + 1}", f"MAC{i % 3 + 1}", i % 2, f"O{i % 4}" if i else None,
                         1 + 8 * (i % 2), 1.0 * i, 2.0 * i if i % 5 else float("nan"), 0.5 * i, events + i, i % 3, i % 2, i % 4))
    names = "m string, factory_id string, machine_id string, product_id int, operator_id string, sensor_type_id int, avg_reading double, max_reading double, min_reading double, num_events bigint, planned_downtime_sec int, unplanned_downtime_sec int, num_alerts bigint"
    frame = spark.createDataFrame(rows, names).withColumn("kpi_minute_start_utc", F.to_timestamp("m")).drop("m")
    return kpi_table_rows(frame)


@pytest.fixture
def out(spark, tmp_path):
    path = str(tmp_path / "out")
    swap_partitions(kpi_rows(spark, 0, 54), f"{path}/minute_kpi", KPI_TABLE_PARTITIONS)
    return path


def both(spark, out, dims, by, start=None, end=None, **options):
    kpi = between(spark.read.parquet(f"{out}/minute_kpi"), start, end)
    pair = summarise(kpi, dims, by, **options), summarise_rolled(spark, out, dims, by, start=start, end=end, **options)
    assert pair[0].columns == pair[1].columns
    return [sorted(map(repr, df.collect())) for df in pair]


RANGES = [
    (None, None),
    ("2024-01-01 00:00:00", "2024-01-03 00:00:00"),
    ("2024-01-01 05:30:00", "2024-01-02 03:00:00"),
    ("2024-01-01 05:00:00", None),
    (None, "2024-01-03 04:12:00"),
    ("2024-01-02 03:10:00", "2024-01-02 03:40:00"),
    ("2025-01-01 00:00:00", None),
]


@pytest.mark.parametrize("start, end", RANGES)
def test_sums_equal_the_kpi_table(spark, dims, out, start, end):
    assert refresh_rollups(spark, out) == 54 and refresh_rollups(spark, out) == 0
    for by, more in ((["criticality"], {}), (["product_id", "operator_id"], {}), (["kpi_date"], {}),
                     (["kpi_hour", "sensor_type_name"], {"having": F.col("num_events") > 50})):
        want, got = both(spark, out, dims, by, start, end, **more)
        assert got == want


def test_filters_and_large_dimensions(spark, dims, out):
    refresh_rollups(spark, out)
    end = "2024-01-02 12:30:00"
    for where, on in ((F.col("criticality") == "High", ["criticality"]), (F.col("operator_id").isNull(), ["operator_id"]), (F.col("num_events") > 8, [])):
        for limit in (0, 10**6):
            want, got = both(spark, out, dims, ["factory_id"], None, end, where=where, where_on=on, max_bytes=limit)
            assert got == want != []


def test_the_coarsest_table_answers(spark, dims, out):
    refresh_rollups(spark, out)
    found = route(spark, out, ["machine_id"], "2024-01-01 00:00:00", "2024-01-03 02:30:00")
    assert found.keys == "machine" and found.days == ("2024-01-01", "2024-01-02")
    assert found.hours == (("2024-01-03", 0), ("2024-01-03", 1)) and found.minutes == (("2024-01-03", 2),)
    assert route(spark, out, ["operator_id"], None, None).keys == "full"
    assert route(spark, out, ["kpi_hour"], None, None).days == ()
    assert route(spark, out, ["kpi_minute_start_utc"], None, None).keys is None
    files = summarise_rolled(spark, out, dims, ["criticality"], end="2024-01-03 00:00:00").inputFiles()
    assert files and all("/kpi_day_machine/" in f for f in files)


def test_changed_hours_are_read_from_the_kpi_table_until_summed_up(spark, dims, out):
    refresh_rollups(spark, out)
    swap_partitions(kpi_rows(spark, 30, 1, events=100), f"{out}/minute_kpi", KPI_TABLE_PARTITIONS)
    swap_partitions(kpi_rows(spark, 60, 2), f"{out}/minute_kpi", KPI_TABLE_PARTITIONS)
    found = route(spark, out, ["factory_id"], None, None)
    assert found.minutes == (("2024-01-02", 6), ("2024-01-03", 12), ("2024-01-03", 13)) and found.days == ("2024-01-01",)
    want, got = both(spark, out, dims, ["factory_id"])
    assert got == want
    old = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{out}/kpi_hour_full/kpi_date=2024-01-01/**/*.parquet", recursive=True)}
    assert refresh_rollups(spark, out) == 3
    assert all(os.stat(f).st_mtime_ns == t for f, t in old.items()) and len(old) == 24
    assert route(spark, out, ["factory_id"], None, None).minutes == ()
    want, got = both(spark, out, dims, ["factory_id", "kpi_date"])
    assert got == want


@pytest.mark.parametrize("calls", [1, 2, 3, 4])
def test_a_refresh_that_dies_leaves_right_answers(spark, dims, out, monkeypatch, calls):
    refresh_rollups(spark, out)
    swap_partitions(kpi_rows(spark, 30, 20, events=100), f"{out}/minute_kpi", KPI_TABLE_PARTITIONS)
    real, made = rollups.swap_partitions, []

    def dying(*args):
        made.append(1)
        if len(made) == calls:
            raise OSError("killed")
        real(*args)

    monkeypatch.setattr(rollups, "swap_partitions", dying)
    with pytest.raises(OSError):
        refresh_rollups(spark, out)
    monkeypatch.undo()
    want, got = both(spark, out, dims, ["factory_id"])
    assert got == want
    refresh_rollups(spark, out)
    want, got = both(spark, out, dims, ["factory_id"])
    assert got == want


def test_without_sums(spark, dims, out):
    want, got = both(spark, out, dims, ["criticality"], "2024-01-01 10:00:00", None)
    assert got == want and route(spark, out, ["machine_id"], None, None).hours == ()
