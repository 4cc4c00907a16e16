"""Result tables keep their rows when a writer dies at any step of a replacement."""

import glob
import threading

import pytest
from pyspark.sql import functions as F

from plantpulse.sinks import tables
from plantpulse.sinks.tables import PENDING, in_same_partitions, open_table, upsert

SCHEMA = "k string, v int, d date, h int"
KEYS, PARTS = ("k", "d", "h"), ("d", "h")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v int, d string, h int").withColumn("d", F.to_date("d"))


def rows(spark, path):
    return sorted((r["k"], r["v"]) for r in open_table(spark, path, frame(spark, ("", 0, None, 0)).schema).collect())


@pytest.fixture
def path(spark, tmp_path):
    root = str(tmp_path / "t")
    upsert(spark, frame(spark, ("a", 1, "2024-01-01", 1), ("b", 1, "2024-01-01", 2), ("c", 1, None, None)), root, KEYS, PARTS)
    return root


@pytest.mark.parametrize("step", ["_note", "before", "between", "after"])
def test_a_writer_killed_at_any_step(spark, path, monkeypatch, step):
    new = frame(spark, ("a", 2, "2024-01-01", 1), ("b", 2, "2024-01-01", 2), ("c", 2, None, None), ("e", 2, "2024-01-02", 1))
    real, calls = tables._take_place, []

    def dying(files, made, old):
        calls.append(1)
        if len(calls) == 2:
            if step == "between":
                files.delete(old, True)
            if step == "after":
                real(files, made, old)
            raise OSError("killed")
        real(files, made, old)

    def note(*args):
        raise OSError("killed")

    monkeypatch.setattr(tables, *(("_note", note) if step == "_note" else ("_take_place", dying)))
    with pytest.raises(OSError):
        upsert(spark, new, path, KEYS, PARTS)
    monkeypatch.undo()
    old = [("a", 1), ("b", 1), ("c", 1)]
    assert rows(spark, path) == (old if step == "_note" else [("a", 2), ("b", 2), ("c", 2), ("e", 2)])
    upsert(spark, new, path, KEYS, PARTS)
    assert rows(spark, path) == [("a", 2), ("b", 2), ("c", 2), ("e", 2)]
    assert glob.glob(f"{path}/{PENDING}/*.json") == []
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == rows(spark, path)


def test_nothing_is_left_beside_the_table(spark, path):
    upsert(spark, frame(spark, ("a", 3, "2024-01-01", 1)), path, KEYS, PARTS)
    assert glob.glob(f"{path}/{PENDING}") == [] and rows(spark, path) == [("a", 3), ("b", 1), ("c", 1)]


def test_threads_take_turns(spark, path):
    threads = [
        threading.Thread(target=upsert, args=(spark, frame(spark, (f"t{i}", i, "2024-01-01", 1)), path, KEYS, PARTS)) for i in range(4)
    ]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert rows(spark, path) == [("a", 1), ("b", 1), ("c", 1), *((f"t{i}", i) for i in range(4))]


def test_a_value_far_away_opens_its_own_partition_only(spark, path, monkeypatch):
    upsert(spark, frame(spark, ("m", 1, "2001-01-01", 7)), path, KEYS, PARTS)
    old = open_table(spark, path, frame(spark, ("", 0, None, 0)).schema)
    new = frame(spark, ("x", 1, "1970-01-01", 1), ("y", 1, "2024-01-01", 1))
    found = in_same_partitions(old, new, PARTS)
    pruned = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0]
    assert "1970-01-01" in pruned and "2024-01-01" in pruned and ">=" not in pruned
    assert [r["k"] for r in found.collect()] == ["a"]
    assert in_same_partitions(old, new.limit(0), PARTS).count() == 0
    monkeypatch.setattr(tables, "LISTED_VALUES", 1)
    assert [r["k"] for r in in_same_partitions(old, new, PARTS).collect()] == ["a"]


def test_partitions_without_new_rows_are_emptied_when_asked(spark, path):
    tables.swap_partitions(frame(spark, ("z", 9, "2024-01-01", 1)), path, PARTS, [("2024-01-01", 1), ("2024-01-01", 2), ("2030-01-01", 1)])
    assert rows(spark, path) == [("c", 1), ("z", 9)]


def test_a_large_partition_is_dealt_among_tasks(spark, tmp_path):
    path = str(tmp_path / "table")
    # one hour of well over the least size that adaptive execution leaves to a task
    rows = spark.range(400_000).selectExpr("sha2(string(id), 256) AS text", "double(id) AS value", "id % 1 AS hour")
    tables.swap_partitions(rows, path, ["hour"])
    files = list((tmp_path / "table" / "hour=0").glob("part-*"))
    assert len(files) > 1 and spark.read.parquet(path).count() == 400_000
    assert spark.read.parquet(path).columns == ["text", "value", "hour"]
