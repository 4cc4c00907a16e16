"""Physical plans: pushed filters, pruned columns, broadcasts, number of shuffles, no Python."""

import re

import pytest
from conftest import SMALL

from plantpulse.operators.conform import conform_machines, conform_readings, within_lookback
from plantpulse.operators.enrich import enrich
from plantpulse.operators.kpi import minute_kpi, minute_stats_all_levels
from plantpulse.plans.catalog import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|single|range|round)", plan(df)))


@pytest.fixture(scope="module")
def stored(spark, make, dims, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "readings")
    make({}, {"machine_id": "MAC2"}).write.parquet(path)
    raw = spark.read.parquet(path)
    recent = within_lookback(conform_readings(raw), "2024-01-01 12:00:00", 6000)
    return enrich(recent, conform_machines(dims["dim_machine"]), dims["dim_sensor_type"])


def test_kpi_scans_once_shuffles_once_and_broadcasts_the_lookups(stored):
    text = plan(minute_kpi(stored))
    assert text.count("FileScan parquet") == 1
    assert shuffles(minute_kpi(stored)) == 2  # of the groups, and of the machine table for one row per code
    assert text.count("BroadcastHashJoin") == 2
    assert "partial_avg" in text and "partial_count" in text


def test_time_filter_reaches_the_scan_and_columns_are_pruned(stored, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    try:
        kpi, all_levels = plan(minute_kpi(stored)), plan(minute_stats_all_levels(stored))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: (.*?), ReadSchema", kpi).group(1)
    assert "GreaterThanOrEqual(event_timestamp,2023-12-28 08:00:00)" in pushed
    read = [set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>", p).group(1))) for p in (kpi, all_levels)]
    assert not read[0] & {"_id", "factory_id"}
    assert read[1] == {"machine_id", "sensor_type_id", "product_id", "event_timestamp", "reading_value"}


def test_with_large_machines_only_groups_are_shuffled_for_the_join(spark, make, dims):
    from plantpulse.operators.enrich import with_limits

    recent = within_lookback(conform_readings(make({})), "2024-01-01 12:00:00", 6000)
    kpi = minute_kpi(with_limits(recent, dims["dim_sensor_type"]), machines=conform_machines(dims["dim_machine"]))
    text = plan(kpi)
    assert text.index("SortMergeJoin") < text.index("HashAggregate")  # printed top down


def test_all_levels_take_one_scan_and_expand_only_aggregated_rows(stored):
    text = plan(minute_stats_all_levels(stored))
    assert text.count("FileScan parquet") == 1
    expand, first_aggregate = text.index("Expand"), text.rindex("HashAggregate")
    assert expand < first_aggregate  # printed top down: the expansion sits above an aggregate


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_python_and_no_cross_join(spark, name):
    if name.startswith("stream_"):
        pytest.skip("the plan of a drained stream is a file scan")
    text = plan(queries()[name](spark, SMALL))
    for node in ("Python", "Pandas", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text
