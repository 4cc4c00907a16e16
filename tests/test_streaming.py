import json
import os

import pytest
from pyspark.sql import functions as F

from plantpulse.operators.alerts import threshold_alerts
from plantpulse.operators.conform import conform_machines, conform_readings, conform_sensors
from plantpulse.operators.enrich import enrich
from plantpulse.operators.kpi import KPI_MINUTE, freshness, minute_kpi
from plantpulse.plans import catalog
from plantpulse.schemas import READING
from plantpulse.sinks.hot import open_hot
from plantpulse.sources.readings import decode_messages
from plantpulse.streaming import live

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of message files read as a stream; ``add`` puts one more file there."""

    class Feed:
        path, n = tmp_path / "in", 0

        def __init__(self):
            self.path.mkdir()

        def add(self, *rows):
            usual = {"machine_id": "MAC1", "sensor_type_id": 1, "operator_id": "OPR1", "product_id": 1,
                     "reading_value": 20.0, "is_downtime": False, "planned_downtime": False}
            lines = [json.dumps({**usual, **r}) for r in rows]
            file = self.path / f"{self.n:04d}.txt"
            file.write_text("\n".join(lines) + "\n")
            self.n += 1
            os.utime(file, (1_700_000_000 + self.n,) * 2)  # files are taken in the order of their times

        def stream(self):
            text = spark.readStream.option("maxFilesPerTrigger", 1).text(str(self.path))
            return decode_messages(text)

    return Feed()


@pytest.fixture
def joined(dims):
    def run(raw):
        return enrich(
            conform_readings(raw), conform_machines(dims["dim_machine"]), conform_sensors(dims["dim_sensor_type"])
        )

    return run


def at(minute, second=0):
    return f"2024-01-01 10:{minute:02d}:{second:02d}"


def test_store_stream_keeps_every_message_once_over_restarts(spark, feed, tmp_path):
    hot, ck = str(tmp_path / "hot"), str(tmp_path / "ck")
    feed.add({"_id": "1", "event_timestamp": at(0)}, {"_id": "2", "event_timestamp": "bad"})
    live.store_stream(feed.stream(), hot, ck, cadence=None).awaitTermination()
    feed.add({"_id": "3", "event_timestamp": at(1)})
    live.store_stream(feed.stream(), hot, ck, cadence=None).awaitTermination()
    live.store_stream(feed.stream(), hot, ck, cadence=None).awaitTermination()
    rows = open_hot(spark, hot)
    assert sorted(r["_id"] for r in rows.collect()) == ["1", "2", "3"]
    assert sorted(str(r[0]) for r in rows.select("event_hour").distinct().collect()) == ["10", "None"]


def test_archive_run_works_on_a_streamed_hot_store(spark, feed, tmp_path):
    from plantpulse.operators.retention import SizePolicy
    from plantpulse.plans.jobs import run_size_archive

    hot, ck = str(tmp_path / "hot"), str(tmp_path / "ck")
    feed.add(*({"_id": f"{i}", "event_timestamp": at(i)} for i in range(30)))
    live.store_stream(feed.stream(), hot, ck, cadence=None).awaitTermination()
    result = run_size_archive(spark, hot, str(tmp_path / "a"), str(tmp_path / "m"), run_id="r", archived_at=at(0),
                              policy=SizePolicy(threshold_mb=0))
    feed.add({"_id": "late", "event_timestamp": at(1)})
    live.store_stream(feed.stream(), hot, ck, cadence=None).awaitTermination()
    assert result.docs_archived == 14
    assert open_hot(spark, hot).count() == 17


def test_redeliveries_are_dropped_across_batches(spark, feed, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    same = {"_id": "1", "event_timestamp": at(0)}
    feed.add(same, same, {"_id": "2", "event_timestamp": at(1)})
    feed.add(same, {"_id": "3", "event_timestamp": at(2)}, {"_id": "odd", "event_timestamp": "bad"})
    rows = live.without_redeliveries(conform_readings(feed.stream()))
    live.append_stream(rows, out, ck, cadence=None).awaitTermination()
    assert sorted(r["_id"] for r in spark.read.parquet(out).collect()) == ["1", "2", "3", "odd"]


def test_kpi_stream_equals_batch_when_minutes_grow_over_batches(spark, feed, joined, tmp_path):
    out, ck = str(tmp_path / "kpi"), str(tmp_path / "ck")
    rows = [
        {"_id": f"{i}", "event_timestamp": at(i % 4, i), "reading_value": float(i), "product_id": None if i % 3 else 1,
         "is_downtime": i % 2 == 0, "planned_downtime": i % 4 == 0}
        for i in range(40)
    ]
    for n in range(0, 40, 10):
        feed.add(*rows[n:n + 10])
    live.kpi_stream(joined(feed.stream()), out, ck, cadence=None).awaitTermination()
    batch = minute_kpi(joined(spark.read.schema(READING).json(str(feed.path))))
    streamed = spark.read.parquet(out).select(batch.columns)
    assert sorted(map(repr, streamed.collect())) == sorted(map(repr, batch.collect()))
    assert streamed.agg(F.sum("num_events")).first()[0] == 40


def test_newest_minute_advances_with_new_readings(spark, feed, joined, tmp_path):
    out, ck = str(tmp_path / "kpi"), str(tmp_path / "ck")
    seen = []
    for minute in (1, 5):
        feed.add({"_id": f"{minute}", "event_timestamp": at(minute)})
        live.kpi_stream(joined(feed.stream()), out, ck, cadence=None).awaitTermination()
        seen.append(freshness(spark.read.parquet(out)).first())
    assert seen[0]["latest_minute"] < seen[1]["latest_minute"] and [r["rows"] for r in seen] == [1, 2]


def test_readings_later_than_the_watermark_are_left_to_the_batch_job(spark, feed, joined, tmp_path):
    out, ck = str(tmp_path / "kpi"), str(tmp_path / "ck")
    feed.add({"_id": "1", "event_timestamp": at(0)})
    feed.add({"_id": "2", "event_timestamp": at(50)})
    feed.add({"_id": "3", "event_timestamp": at(55)})
    feed.add({"_id": "late", "event_timestamp": at(0, 30)}, {"_id": "ok", "event_timestamp": at(50, 30)})
    query = live.kpi_stream(joined(feed.stream()), out, ck, cadence=None)
    query.awaitTermination()
    assert query.lastProgress.stateOperators[0].numRowsTotal == 2  # the first minute has left the state
    events = {str(r[KPI_MINUTE])[14:16]: r["num_events"] for r in spark.read.parquet(out).collect()}
    assert events == {"00": 1, "50": 2, "55": 1}


def test_alert_stream_keeps_each_reading_once(spark, feed, joined, tmp_path):
    out, ck = str(tmp_path / "alerts"), str(tmp_path / "ck")
    hot = {"_id": "1", "event_timestamp": at(0), "reading_value": 99.0}
    feed.add(hot, {"_id": "2", "event_timestamp": at(0), "reading_value": 15.0})
    feed.add(hot, {"_id": "3", "event_timestamp": at(1), "reading_value": 1.0})
    rows = threshold_alerts(joined(live.without_redeliveries(conform_readings(feed.stream()))), with_reading_id=True)
    live.alert_stream(rows, out, ck, cadence=None).awaitTermination()
    got = {r["reading_id"]: r["severity"] for r in spark.read.parquet(out).collect()}
    assert got == {"1": "CRITICAL", "3": "WARNING"} and spark.read.parquet(out).count() == 2


def test_a_batch_delivered_again_changes_nothing(spark, make, enriched, tmp_path):
    out = str(tmp_path / "kpi")
    write = live.upsert_each(out, live.KPI_TABLE_KEYS, live.KPI_TABLE_PARTITIONS)
    batch = live.kpi_table_rows(minute_kpi(enriched(make({}, {"product_id": None}, {"machine_id": "MAC2"}))))
    write(batch, 0)
    first = sorted(map(repr, spark.read.parquet(out).collect()))
    write(batch, 0)
    assert sorted(map(repr, spark.read.parquet(out).collect())) == first and len(first) == 3


def test_trigger_is_a_minute_by_default_and_once_without_cadence():
    seen = {}

    class Writer:
        def option(self, key, value):
            seen[key] = value
            return self

        def trigger(self, **kwargs):
            seen.update(kwargs)
            return self

        def start(self):
            return dict(seen)

    assert live.start(Writer(), "ck", live.CADENCE) == {"checkpointLocation": "ck", "processingTime": "1 minute"}
    assert live.start(Writer(), "ck", None)["availableNow"] is True


def test_feeds_are_written_by_all_tasks_and_a_folder_is_one_batch(spark, tmp_path, monkeypatch):
    tables = tmp_path / "tables"
    tables.mkdir()
    for name in ("supplier", "customer", "part", "nation", "region"):
        (tables / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(4, "event_id").write.parquet(f"{tables}/events.parquet")
    monkeypatch.setattr(catalog, "work_path", lambda _, label: str(tmp_path / label))
    for name, label, parts, log in (
        ("stream_late", "late", 3, "counted"), ("stream_dimension_change", "moving", 2, "checkpoint")
    ):
        query = catalog.queries()[name]
        found = sorted(map(repr, query(spark, str(tables)).collect()))
        assert all(len(list((tmp_path / label / "feed" / str(n)).glob("part-*"))) > 1 for n in range(parts))
        assert len(list((tmp_path / label / log / "commits").glob("[0-9]*"))) == parts
        monkeypatch.setattr(catalog, "work_path", lambda _, label: str(tmp_path / "whole" / label))
        assert found == sorted(map(repr, query(spark, SMALL).collect()))
        monkeypatch.setattr(catalog, "work_path", lambda _, label: str(tmp_path / label))
