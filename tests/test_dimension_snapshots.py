"""Dimensions that change under a stream, and alerts that are appended without state."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from plantpulse.plans import jobs
from plantpulse.schemas import READING
from plantpulse.sources.snapshots import dimension_source, open_dimension, publish_dimension, snapshots


@pytest.fixture
def root(dims, tmp_path):
    for name in ("dim_machine", "dim_sensor_type"):
        publish_dimension(dims[name], str(tmp_path / "dims"), name)
    return str(tmp_path / "dims")


def readings(make, first, last, **more):
    return make(*({"_id": f"r{i}", "event_timestamp": f"2024-01-01 10:{i:02d}:05", "reading_value": 50.0, **more} for i in range(first, last)))


def feed_of(spark, path, *batches):
    for n, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(f"{path}/{n}")
    source = spark.readStream.schema(READING).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
    return source.parquet(path)


def moving(spark, root, dims):
    """Publishes a machine table with another factory before every batch but the first."""
    known, asked = dimension_source(spark, root), []

    def now():
        if asked:
            publish_dimension(dims["dim_machine"].withColumn("factory_id", F.lit(f"MOVED{len(asked)}")), root, "dim_machine")
        asked.append(1)
        return known()

    return now


def test_snapshots_are_whole_numbered_and_few(spark, dims, root):
    for _ in range(4):
        publish_dimension(dims["dim_machine"], root, "dim_machine")
    assert snapshots(spark, root, "dim_machine") == [2, 3, 4]
    # one that a publisher did not finish does not count
    open_dimension(spark, root, "dim_machine").limit(0).write.parquet(f"{root}/dim_machine/snapshot=5")
    os.remove(f"{root}/dim_machine/snapshot=5/_SUCCESS")
    assert snapshots(spark, root, "dim_machine")[-1] == 4 and open_dimension(spark, root, "dim_machine").count() == 3
    assert publish_dimension(dims["dim_machine"], root, "dim_machine") == 5
    with pytest.raises(FileNotFoundError):
        open_dimension(spark, root, "dim_product")
    assert set(dimension_source(spark, root)()) == {"dim_machine", "dim_sensor_type"}


def test_a_machine_moves_between_two_batches(spark, make, dims, root, tmp_path):
    feed = feed_of(spark, str(tmp_path / "feed"), readings(make, 0, 10), readings(make, 10, 20))
    out, dims_now = str(tmp_path / "alerts"), moving(spark, root, dims)
    jobs.live_alerts(feed, dims_now, out, str(tmp_path / "c"), cadence=None).awaitTermination()
    found = {r["factory_id"]: r["n"] for r in spark.read.parquet(out).groupBy("factory_id").agg(F.count("*").alias("n")).collect()}
    assert found == {"FCT1": 10, "MOVED1": 10}
    hot, tables = str(tmp_path / "hot"), str(tmp_path / "tables")
    jobs.live_kpi(feed, moving(spark, root, dims), hot, tables, str(tmp_path / "c2"), cadence=None).awaitTermination()
    found = spark.read.parquet(f"{tables}/minute_kpi").groupBy("factory_id").agg(F.sum("num_events")).collect()
    # the newest snapshot there was, and the one published before the second batch
    assert sorted(map(tuple, found)) == [("MOVED1", 20)]


def test_the_join_follows_the_size_of_the_day(spark, make, dims, root, tmp_path, monkeypatch):
    seen = []
    real = jobs.measured_bytes
    monkeypatch.setattr(jobs, "measured_bytes", lambda t: seen.append(real(t)) or seen[-1])
    feed = feed_of(spark, str(tmp_path / "feed"), readings(make, 0, 5), readings(make, 5, 10))
    known, asked = dimension_source(spark, root), []

    def now():
        if asked:
            more = [dims["dim_machine"].withColumn("machine_id", F.concat("machine_id", F.lit(f"-{i}"))) for i in range(5)]
            grown = dims["dim_machine"]
            for m in more:
                grown = grown.unionAll(m)
            publish_dimension(grown, root, "dim_machine")
        asked.append(1)
        return known()

    limit = real({"machines": jobs.conform_machines(dims["dim_machine"])})["machines"] + 1
    out = str(tmp_path / "alerts")
    jobs.live_alerts(feed, now, out, str(tmp_path / "c"), cadence=None, max_bytes=limit).awaitTermination()
    assert [s["machines"] <= limit for s in seen] == [True, False] and spark.read.parquet(out).count() == 10


def test_alerts_are_appended_once_and_hours_not_rewritten(spark, make, dims, tmp_path):
    first = readings(make, 0, 10)
    feed = feed_of(spark, str(tmp_path / "feed"), first, first.unionAll(readings(make, 5, 15)), readings(make, 0, 20, reading_value=20.0))
    out = str(tmp_path / "alerts")
    jobs.live_alerts(feed, dims, out, str(tmp_path / "c"), cadence=None).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(out).select("reading_id").collect()) == sorted(f"r{i}" for i in range(15))
    files = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{out}/**/*.parquet", recursive=True)}
    again = feed_of(spark, str(tmp_path / "feed2"), readings(make, 14, 18))
    for checkpoint in ("c3", "c4"):  # a batch that comes again adds nothing
        jobs.live_alerts(again, dims, out, str(tmp_path / checkpoint), cadence=None).awaitTermination()
        assert spark.read.parquet(out).count() == 18
    assert all(os.stat(f).st_mtime_ns == t for f, t in files.items())
