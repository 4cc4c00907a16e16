import pytest
from pyspark.sql import functions as F

from plantpulse.operators.conform import conform_machines, conform_readings, within_lookback
from plantpulse.operators.enrich import enrich
from plantpulse.operators.lookup import attach, fits_broadcast, measured_bytes


def test_conform_normalises_machine_only_when_asked(make):
    raw = make({"machine_id": "  mac1 "})
    assert conform_readings(raw).first()["machine_id"] == "MAC1"
    assert conform_readings(raw, normalise=False).first()["machine_id"] == "  mac1 "


def test_conform_turns_bad_values_into_null(spark):
    bad = spark.createDataFrame(
        [("1", "F", "M", "one", "O", "1.5x", "2024-01-01 10:00:00", "high", "maybe", "true")],
        "_id string, factory_id string, machine_id string, sensor_type_id string, operator_id string, "
        "product_id string, event_timestamp string, reading_value string, is_downtime string, planned_downtime string",
    )
    row = conform_readings(bad).first()
    assert [row[c] for c in ("sensor_type_id", "product_id", "reading_value", "is_downtime")] == [None] * 4
    assert row["planned_downtime"] is True


def test_lookback_keeps_its_edge_and_drops_unparsed(make):
    raw = make(
        {"event_timestamp": "2024-01-01 09:59:59"},
        {"event_timestamp": "2024-01-01 10:00:00"},
        {"event_timestamp": "bad"},
        {"event_timestamp": None},
    )
    kept = within_lookback(conform_readings(raw), "2024-01-01 12:00:00", 120)
    assert [r["_id"] for r in kept.collect()] == ["2"]


def test_lookback_on_whole_minutes_starts_with_the_minute(make):
    raw = make({"event_timestamp": "2024-01-01 10:00:10"}, {"event_timestamp": "2024-01-01 09:59:59"})
    args = (conform_readings(raw), "2024-01-01 12:00:30", 120)
    assert within_lookback(*args).count() == 0
    assert [r["_id"] for r in within_lookback(*args, whole_minutes=True).collect()] == ["1"]


def test_enrich_takes_the_machines_factory_and_drops_unknown_machines(make, enriched):
    raw = make({"machine_id": " mac2"}, {"machine_id": "MAC3"}, {"machine_id": "MAC9"}, {"machine_id": None})
    rows = enriched(raw).collect()
    assert [(r["_id"], r["factory_id"]) for r in rows] == [("1", "FCT2")]
    assert str(rows[0]["minute_ts"]) == "2024-01-01 10:00:00"
    assert enriched(raw, normalise=False).count() == 0


def test_unknown_sensor_stays_without_limits(make, enriched):
    row = enriched(make({"sensor_type_id": 77})).first()
    assert row["typical_max"] is None and row["sensor_type_name"] is None


def test_measured_bytes_counts_text(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "k string")
    sizes = measured_bytes({"x": df, "none": df.where("false")})
    assert sizes == {"x": len('{"k":"ab"}') + len('{"k":"c"}'), "none": 0}
    assert fits_broadcast(df, sizes["x"]) and not fits_broadcast(df, sizes["x"] - 1)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_large_lookup_gives_the_same_rows(spark, how):
    fact = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), "id"
    )
    fact = fact.unionAll(spark.createDataFrame([(None, 1), ("hot", 1)], "k string, id bigint"))
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "k string, v int")
    small = attach(fact, lookup, "k", how=how, max_bytes=10**6)
    large = attach(fact, lookup, "k", how=how, max_bytes=0)
    assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect()))
    assert small.columns == large.columns
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_large_lookup_leaves_a_hot_key_to_be_split(spark):
    """The join's inputs are two plain shuffles, which adaptive execution splits; the lookup is not repeated."""
    fact = spark.range(0, 6400, 1, 64).select(F.when(F.col("id") >= 0, "hot").otherwise("cold").alias("k"), F.lit(1).alias("x"))
    lookup = spark.createDataFrame([("hot", 1)], "k string, v int")
    joined = attach(fact, lookup, "k", broadcast=False)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") == 2 and "Generate" not in plan and joined.count() == 6400


def test_enrich_by_shuffle_equals_enrich_by_broadcast(make, dims):
    raw = make(*({"machine_id": m} for m in ("MAC1", "MAC2", "MAC3", "MAC9", None) for _ in range(5)))
    args = (conform_readings(raw), conform_machines(dims["dim_machine"]), dims["dim_sensor_type"])
    small, large = enrich(*args, known_only=False), enrich(*args, known_only=False, max_bytes=0)
    assert small.count() == 25
    assert sorted(map(repr, small.collect())) == sorted(map(repr, large.select(small.columns).collect()))
