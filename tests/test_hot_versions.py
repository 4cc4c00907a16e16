"""The hot store under failures, several writers, deletes by identity and compaction."""

import glob
import os
import threading

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plantpulse.sinks import hot as store
from plantpulse.sinks import versions
from plantpulse.sinks.hot import compact_hot, delete_hot, hot_bytes, hot_version, open_hot, sweep_hot, write_hot_batch


def ids(df):
    return sorted(r["_id"] for r in df.select("_id").collect())


def some(make, first, last, **more):
    return make(*(
        {"_id": f"r{i:03d}", "machine_id": f"MAC{i % 7}", "event_timestamp": f"2024-01-01 10:{i % 60:02d}:{i % 50:02d}", **more}
        for i in range(first, last)
    ))


@pytest.fixture
def path(make, tmp_path):
    root = str(tmp_path / "hot")
    write_hot_batch(some(make, 0, 100), root, "a-0")
    return root


def files(path):
    return set(glob.glob(f"{path}/event_date=*/**/*.parquet", recursive=True))


class Killed(RuntimeError):
    pass


def kill(*args, **options):
    raise Killed


@pytest.mark.parametrize("step", ["_publish", "expire"])
@pytest.mark.parametrize("act", ["write", "rewrite", "delete", "compact"])
def test_a_writer_killed_at_any_step_leaves_all_or_nothing(spark, make, path, monkeypatch, step, act):
    delete_hot(spark, path, some(make, 90, 95))
    before = ids(open_hot(spark, path))
    acts = {
        "write": (lambda: write_hot_batch(some(make, 100, 110), path, "a-1"), sorted(before + [f"r{i}" for i in range(100, 110)])),
        "rewrite": (lambda: write_hot_batch(some(make, 0, 3), path, "a-0"), ["r000", "r001", "r002"]),
        "delete": (lambda: delete_hot(spark, path, some(make, 0, 50)), before[50:]),
        "compact": (lambda: compact_hot(spark, path), before),
    }
    run, after = acts[act]
    monkeypatch.setattr(versions, step, kill)
    with pytest.raises(Killed):
        run()
    assert ids(open_hot(spark, path)) == (before if step == "_publish" else after)
    monkeypatch.undo()
    run()
    assert ids(open_hot(spark, path)) == after
    sweep_hot(spark, path, hours=0)
    assert ids(open_hot(spark, path)) == after
    listed = {f.path for f in versions.version(spark, path).folders}
    assert {os.path.relpath(os.path.dirname(f), path) for f in files(path)} <= listed


def test_two_writers_and_a_delete_at_once_lose_nothing(spark, make, path):
    frames = [some(make, 100 + 20 * i, 120 + 20 * i) for i in range(4)]
    work = [lambda i=i: write_hot_batch(frames[i], path, f"b-{i}") for i in range(4)]
    gone = some(make, 0, 30)
    work.append(lambda: delete_hot(spark, path, gone))
    failed = []

    def guarded(run):
        try:
            run()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=guarded, args=(w,)) for w in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert failed == []
    assert ids(open_hot(spark, path)) == [f"r{i:03d}" for i in range(30, 180)]
    assert hot_version(spark, path) == 5


def test_a_change_on_replaced_folders_is_worked_out_anew(spark, make, path, monkeypatch):
    real, calls = versions.commit, []

    def overtaken(*args, **options):
        monkeypatch.setattr(versions, "commit", real)
        calls.append(1)
        delete_hot(spark, path, some(make, 10, 20))  # while the other one is about to publish
        return real(*args, **options)

    delete_hot(spark, path, some(make, 0, 5))
    monkeypatch.setattr(versions, "commit", overtaken)
    compact_hot(spark, path)
    assert calls == [1]
    assert ids(open_hot(spark, path)) == [f"r{i:03d}" for i in [*range(5, 10), *range(20, 100)]]


def test_a_batch_that_came_twice_at_once_counts_once(spark, make, path, monkeypatch):
    real = versions.commit

    def overtaken(*args, **options):
        monkeypatch.setattr(versions, "commit", real)
        write_hot_batch(some(make, 200, 205), path, "b-0")
        return real(*args, **options)

    monkeypatch.setattr(versions, "commit", overtaken)
    write_hot_batch(some(make, 200, 205), path, "b-0")
    assert ids(open_hot(spark, path).where("ingest_batch = 'b-0'")) == [f"r{i}" for i in range(200, 205)]


def test_a_small_delete_writes_identities_only(spark, make, path):
    before, size = files(path), hot_bytes(spark, path)
    assert delete_hot(spark, path, some(make, 40, 41), expected=1) == 1
    assert files(path) == before
    (gone,) = versions.version(spark, path).gone()
    assert gone.bytes == hot_bytes(spark, path) - size < size / 2
    lists = glob.glob(f"{path}/_gone/**/*.parquet", recursive=True)
    assert [pq.read_schema(f).names for f in lists] == [["_id", "holder"]]
    assert len(ids(open_hot(spark, path))) == 99
    with pytest.raises(store.ReconcileError):
        delete_hot(spark, path, some(make, 40, 42), expected=2)
    assert delete_hot(spark, path, some(make, 0, 100)) == 99 and ids(open_hot(spark, path)) == []
    assert files(path) == set() and glob.glob(f"{path}/_gone/*") == []


def test_only_hours_with_deletes_are_joined(spark, make, path):
    write_hot_batch(make({"_id": "x", "event_timestamp": "2024-01-01 12:00:00"}), path, "c-0")
    delete_hot(spark, path, some(make, 0, 1))
    plan = open_hot(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and plan.startswith("Union")
    sides = [f for f in versions.version(spark, path).rows() if f.hour == 12]
    whole = store._rows(spark, path, versions.version(spark, path), sides)
    assert "LeftAnti" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_an_earlier_version_can_be_read_until_it_expires(spark, make, path):
    first = hot_version(spark, path)
    delete_hot(spark, path, some(make, 0, 60), keep_minutes=60)
    write_hot_batch(some(make, 0, 10), path, "a-0", keep_minutes=60)
    compact_hot(spark, path, most_files=0, keep_minutes=60)
    assert len(ids(open_hot(spark, path, first))) == 100
    assert len(ids(open_hot(spark, path, first + 1))) == 40 and len(ids(open_hot(spark, path))) == 10
    reader = open_hot(spark, path)
    write_hot_batch(some(make, 20, 30), path, "a-1", keep_minutes=60)
    assert len(ids(reader)) == 10
    versions.expire(spark, path)
    assert versions.numbers(spark, path) == [hot_version(spark, path)] and len(ids(open_hot(spark, path))) == 20


def test_a_batch_delivered_again_after_a_delete_or_a_compaction(spark, make, path):
    delete_hot(spark, path, some(make, 0, 10))
    write_hot_batch(some(make, 0, 20), path, "a-1")  # other rows of the same identities
    assert len(ids(open_hot(spark, path))) == 110
    compact_hot(spark, path, most_files=0)
    write_hot_batch(some(make, 0, 100), path, "a-0")
    assert len(ids(open_hot(spark, path))) == 120
    write_hot_batch(some(make, 0, 20), path, "a-1")
    assert len(ids(open_hot(spark, path))) == 120
    counts = {r["ingest_batch"]: r["count"] for r in open_hot(spark, path).groupBy("ingest_batch").count().collect()}
    assert counts == {"a-0": 100, "a-1": 20}


def test_compaction_bounds_files_and_leaves_open_hours_alone(spark, make, path):
    from datetime import datetime

    for i in range(6):
        write_hot_batch(some(make, 100 + i, 101 + i), path, f"b-{i}")
    write_hot_batch(make({"_id": "bad", "event_timestamp": "bad"}, {"_id": "next", "event_timestamp": "2024-01-01 11:00:00"}), path, "c")
    write_hot_batch(make({"_id": "bad2", "event_timestamp": "bad"}, {"_id": "next2", "event_timestamp": "2024-01-01 11:00:01"}), path, "d")
    before = sorted(map(repr, open_hot(spark, path).collect()))
    assert compact_hot(spark, path, before=datetime(2024, 1, 1, 11), most_files=1) == 2
    assert sorted(map(repr, open_hot(spark, path).collect())) == before
    count = {f.place: 0 for f in versions.version(spark, path).rows()}
    for f in versions.version(spark, path).rows():
        count[f.place] += f.files
    assert count[("2024-01-01", 10)] == 1 and count[(None, None)] == 1 and count[("2024-01-01", 11)] == 2
    assert compact_hot(spark, path, before=datetime(2024, 1, 1, 11), most_files=1) == 0


def test_compacted_files_can_be_skipped_by_machine_and_by_time(spark, make, tmp_path):
    root = str(tmp_path / "hot")
    rows = make(*(
        {"_id": f"{i}", "machine_id": f"MAC{i % 64:04d}", "event_timestamp": f"2024-01-01 10:{i // 64 % 60:02d}:30"} for i in range(64 * 60)
    ))
    write_hot_batch(rows, root, "a")
    size = hot_bytes(spark, root)
    delete_hot(spark, root, rows.where("_id = '0'"))
    compact_hot(spark, root, file_bytes=size // 16)
    spans = []
    for f in files(root):
        columns = pq.read_table(f, columns=["machine_id", "event_timestamp"])
        spans.append([(min(c), max(c)) for c in (columns[0].to_pylist(), columns[1].to_pylist())])
    assert len(spans) >= 8

    def opened(machine=None, minute=None):
        texts = (machine and f"MAC{machine:04d}", minute and f"2024-01-01 10:{minute:02d}:30")
        return sum(all(t is None or lo <= t <= hi for t, (lo, hi) in zip(texts, s)) for s in spans) / len(spans)

    assert opened(machine=9) <= 0.5 and opened(minute=7) <= 0.5 and opened(9, 7) <= 0.25
    found = open_hot(spark, root).where("machine_id = 'MAC0009' AND event_timestamp = '2024-01-01 10:07:30'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(machine_id,MAC0009)" in plan and found.count() == 1


def test_a_large_hour_is_sorted_in_pieces(spark, make, tmp_path, monkeypatch):
    root = str(tmp_path / "hot")
    rows = make(*(
        {"_id": f"{i}", "machine_id": f"MAC{i % 64:04d}", "event_timestamp": f"2024-01-01 10:{i // 64 % 60:02d}:30"} for i in range(64 * 60)
    ))
    write_hot_batch(rows, root, "a")
    monkeypatch.setattr(store, "SORT_BYTES", hot_bytes(spark, root) // 8, raising=False)
    delete_hot(spark, root, rows.where("_id = '0'"))
    assert compact_hot(spark, root) == 1
    held = [pq.read_metadata(f).num_rows for f in files(root)]
    assert sum(held) == 64 * 60 - 1 and len(held) >= 8 and max(held) < 1000
    assert len(ids(open_hot(spark, root))) == 64 * 60 - 1


def test_hours_of_a_delete_are_listed_one_by_one(spark, make, path):
    write_hot_batch(make({"_id": "old", "event_timestamp": "1970-01-01 00:00:00"}, {"_id": "mid", "event_timestamp": "2001-01-01 00:00:00"}), path, "c")
    times = make({"_id": "old", "event_timestamp": "1970-01-01 00:00:00"}, {"_id": "r001", "event_timestamp": "2024-01-01 10:00:00"})
    hours = store._hours_of(times.selectExpr("_id", "cast(event_timestamp AS timestamp) AS ts"))
    assert ids(open_hot(spark, path).where(hours)) == ["old", *(f"r{i:03d}" for i in range(100))]
    assert delete_hot(spark, path, times) == 2


def test_batch_names_need_no_care(spark, make, tmp_path):
    root = str(tmp_path / "hot")
    write_hot_batch(some(make, 0, 5), root, "a/b: c=%d?")
    assert [r[0] for r in open_hot(spark, root).select("ingest_batch").distinct().collect()] == ["a/b: c=%d?"]
    write_hot_batch(some(make, 0, 5).limit(0), root, "a/b: c=%d?")
    assert open_hot(spark, root).count() == 0 and open_hot(spark, root).columns[-1] == "ingest_batch"
    assert open_hot(spark, root).agg(F.count("_id")).first()[0] == 0
