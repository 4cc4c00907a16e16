"""Lookups that read little: identities through Bloom filters, the newest time from footers."""

import glob

import pyarrow.parquet as pq
import pytest

from plantpulse.operators.retention import cutoff_before, newest_cutoff
from plantpulse.sinks import hot as store
from plantpulse.sinks.archive import append_archive
from plantpulse.sinks.hot import compact_hot, delete_hot, newest_second, open_hot, write_hot_batch
from plantpulse.sources import readings as src
from plantpulse.sources.readings import find_readings, read_archive
from pyspark.sql import functions as F


def scanned(df):
    """Rows that the file scan of a plan without shuffles hands on."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def archive_of(spark, path, hours):
    """2,000 readings an hour; identities are hashes, so every file spans all of them."""
    ids = spark.range(hours * 2000).select(
        F.md5(F.col("id").cast("string")).alias("_id"), F.lit("F").alias("factory_id"), F.lit("M").alias("machine_id"),
        F.lit(1).alias("sensor_type_id"), F.lit("O").alias("operator_id"), F.lit(1).alias("product_id"),
        F.date_format(F.timestamp_seconds(F.floor(F.col("id") / 2000) * 3600 + 1_704_067_200), "yyyy-MM-dd HH:mm:ss").alias("event_timestamp"),
        F.lit(1.0).alias("reading_value"), F.lit(False).alias("is_downtime"), F.lit(False).alias("planned_downtime"),
    )
    append_archive(spark, ids, path)
    return read_archive(spark, path)


def test_what_a_lookup_reads_does_not_grow_with_the_archive(spark, tmp_path):
    wanted = spark.range(5).select(F.md5(F.col("id").cast("string")).alias("_id"))
    read = {}
    for hours in (4, 24):
        archive = archive_of(spark, str(tmp_path / str(hours)), hours)
        found = find_readings(archive, wanted)
        assert sorted(r["_id"] for r in found.collect()) == sorted(r["_id"] for r in wanted.collect())
        read[hours] = scanned(found)
        assert scanned(archive) == hours * 2000
    assert read[24] == read[4] <= 4000  # the hour that has them, and nothing else
    none = spark.createDataFrame([(f"absent{i}",) for i in range(5)], "_id string")
    assert scanned(find_readings(archive, none)) <= 2000


def test_more_identities_than_are_listed_are_joined(spark, tmp_path, monkeypatch):
    archive = archive_of(spark, str(tmp_path / "a"), 2)
    wanted = spark.range(30).select(F.md5(F.col("id").cast("string")).alias("_id"))
    listed = sorted(map(repr, find_readings(archive, wanted).collect()))
    monkeypatch.setattr(src, "LISTED_IDS", 10)
    joined = find_readings(archive, wanted)
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, joined.collect())) == listed and len(listed) == 30
    assert find_readings(archive, wanted.limit(0)).count() == 0
    assert find_readings(archive, spark.createDataFrame([(None,)], "_id string")).count() == 0


@pytest.fixture
def path(make, tmp_path):
    root = str(tmp_path / "hot")
    times = ["09:00:00", "10:59:59", "11:00:01", "11:30:00", "11:45:10"]
    write_hot_batch(make(*({"_id": str(i), "event_timestamp": f"2024-01-01 {t}"} for i, t in enumerate(times))), root, "a")
    write_hot_batch(make({"_id": "bad", "event_timestamp": "bad"}, {"_id": "x", "event_timestamp": "2024-01-01 11:20:00"}), root, "b")
    return root


def test_newest_time_comes_from_footers(spark, path, monkeypatch):
    plans = []
    real = store._footers
    monkeypatch.setattr(store, "_footers", lambda *a: plans.append(real(*a)) or plans[-1])
    assert cutoff_before(newest_second(spark, path), 15) == newest_cutoff(open_hot(spark, path), 15) == "2024-01-01 11:30:10"
    text = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert len(plans) == 1 and "PushedAggregation: [MAX(event_second)]" in text
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_newest_time_after_deletes_and_compaction(spark, make, path):
    def check():
        assert cutoff_before(newest_second(spark, path), 15) == newest_cutoff(open_hot(spark, path), 15)

    for i, t in ((4, "11:45:10"), (3, "11:30:00"), (2, "11:00:01")):
        delete_hot(spark, path, make({"_id": str(i), "event_timestamp": f"2024-01-01 {t}"}))
        check()
    compact_hot(spark, path, most_files=0)
    check()
    for i, t in (("x", "11:20:00"), (1, "10:59:59"), (0, "09:00:00")):
        delete_hot(spark, path, make({"_id": str(i), "event_timestamp": f"2024-01-01 {t}"}))
        check()
    assert newest_second(spark, path) is None and newest_second(spark, path + "-none") is None


def test_the_store_keeps_seconds_to_itself(spark, path):
    assert "event_second" not in open_hot(spark, path).columns
    files = glob.glob(f"{path}/event_date=2024-01-01/**/*.parquet", recursive=True)
    assert all("event_second" in pq.read_schema(f).names for f in files)
