"""Jobs and streams composed: retries, caps, archive runs between KPI runs, changed dimensions."""

import glob

import pytest
from pyspark.sql import functions as F

from plantpulse.operators import star
from plantpulse.operators.conform import conform_readings
from plantpulse.operators.kpi import minute_kpi
from plantpulse.operators.retention import SizePolicy
from plantpulse.plans import jobs
from plantpulse.sinks import archive as archive_sink
from plantpulse.sinks.hot import delete_hot, open_hot, write_hot_batch
from plantpulse.sources.readings import archived_readings, history, read_archive, read_ndjson
from plantpulse.streaming import live

AT = "2024-01-01 12:00:00"


@pytest.fixture
def readings(make):
    """480 readings: four a minute from 10:00 on, at odd seconds."""
    return make(*(
        {"_id": f"r{i:03d}", "machine_id": f"MAC{i % 2 + 1}", "reading_value": float(i % 40),
         "event_timestamp": f"2024-01-01 {10 + i // 240:02d}:{i // 4 % 60:02d}:{i % 4 * 15 + 2:02d}"}
        for i in range(480)
    ))


@pytest.fixture
def hot(readings, tmp_path):
    path = str(tmp_path / "hot")
    write_hot_batch(readings, path, "a-0")
    return path


def size_run(spark, hot, tmp_path, run_id="run", **policy):
    policy = SizePolicy(**{"threshold_mb": 0, "keep_minutes": 15, **policy})
    return jobs.run_size_archive(
        spark, hot, str(tmp_path / "raw"), str(tmp_path / "meta"), run_id=run_id, archived_at=AT, policy=policy
    )


def ids(df):
    return sorted(r["_id"] for r in df.select("_id").collect())


def everything(spark, hot, tmp_path):
    return sorted(ids(open_hot(spark, hot)) + ids(read_ndjson(spark, str(tmp_path / "raw/run_id=*"))))


def test_a_run_called_twice_loses_nothing(spark, readings, hot, tmp_path):
    first = size_run(spark, hot, tmp_path, chunk_docs=10, max_chunks=10)
    assert first.docs_archived == 100 and first.docs_left == 319
    assert size_run(spark, hot, tmp_path, chunk_docs=10, max_chunks=10) == first
    assert everything(spark, hot, tmp_path) == ids(readings)


def test_a_dump_called_twice_loses_nothing(spark, readings, hot, tmp_path):
    args = {"run_id": "run", "as_of": "2024-01-01 12:00:00", "hours": 1}
    first = jobs.run_age_dump(spark, hot, str(tmp_path / "raw"), **args)
    assert jobs.run_age_dump(spark, hot, str(tmp_path / "raw"), **args) == first
    assert first.docs_archived == 240 and everything(spark, hot, tmp_path) == ids(readings)


@pytest.mark.parametrize("step", ["write_chunks", "delete_hot", "write_manifest"])
def test_a_run_that_broke_off_is_finished_by_the_next_call(spark, readings, hot, tmp_path, monkeypatch, step):
    real = getattr(jobs, step)

    def broken(*args, **options):
        if step == "delete_hot":
            real(*args, **options)
        raise OSError("lost")

    monkeypatch.setattr(jobs, step, broken)
    with pytest.raises(OSError):
        size_run(spark, hot, tmp_path, chunk_docs=10, max_chunks=10)
    monkeypatch.setattr(jobs, step, real)
    result = size_run(spark, hot, tmp_path, chunk_docs=10, max_chunks=10)
    assert result.docs_archived == result.docs_deleted == 100
    assert everything(spark, hot, tmp_path) == ids(readings)


def test_without_a_cap_all_candidates_leave(spark, hot, tmp_path):
    result = size_run(spark, hot, tmp_path)
    assert result.docs_left == 0 and open_hot(spark, hot).agg(F.min("event_timestamp")).first()[0] >= "2024-01-01 11:44:47"


def test_copies_leave_together_and_counts_are_compared_before_the_delete(spark, readings, hot, tmp_path):
    write_hot_batch(readings.where("_id IN ('r019', 'r020')"), hot, "a-1")
    result = size_run(spark, hot, tmp_path, chunk_docs=10, max_chunks=2)
    assert result.docs_archived == result.docs_deleted == 21 and ids(open_hot(spark, hot))[0] == "r020"
    with pytest.raises(jobs.ReconcileError):
        delete_hot(spark, hot, readings.where("_id = 'r020'"), expected=1)
    assert ids(open_hot(spark, hot)).count("r020") == 2


def test_chunks_are_full_and_no_more_than_allowed(spark, hot, tmp_path):
    result = size_run(spark, hot, tmp_path, chunk_docs=10, max_chunks=10)
    files = glob.glob(f"{result.files}/*.json")
    assert [sum(1 for _ in open(f)) for f in files] == [10] * 10


def test_emptied_partitions_and_work_folders_go(spark, readings, hot, tmp_path):
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/*"))
    delete_hot(spark, hot, readings.where("event_timestamp < '2024-01-01 11'"))
    assert [p.split("=")[-1] for p in glob.glob(f"{hot}/event_date=*/event_hour=*")] == ["11"]
    assert set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/*")) == before
    delete_hot(spark, hot, readings)
    assert glob.glob(f"{hot}/event_date=*") == []


def table(spark, path):
    df = spark.read.parquet(path)
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_kpis_after_an_archive_run_within_a_minute(spark, hot, dims, tmp_path):
    out, archive = str(tmp_path / "out"), str(tmp_path / "archive")
    jobs.run_minute_kpi(spark, open_hot(spark, hot), dims, AT, out)
    jobs.run_minute_tables(spark, open_hot(spark, hot), dims, AT, out)
    jobs.run_daily(open_hot(spark, hot), out)
    names = ("minute_kpi", "agg_machine_minute", "daily_machine")
    before = [table(spark, f"{out}/{n}") for n in names]
    result = size_run(spark, hot, tmp_path, chunk_docs=10, max_chunks=5)
    assert result.docs_archived % 4 == 2  # the cut is within a minute
    for gone in (archived_readings(spark, chunks=[result.files]), None):
        if gone is None:  # once converted, too
            jobs.run_to_parquet(spark, result.files, archive)
            gone = archived_readings(spark, archive, [result.files])
        jobs.run_minute_kpi(spark, open_hot(spark, hot), dims, AT, out, archived=gone)
        jobs.run_minute_tables(spark, open_hot(spark, hot), dims, AT, out, archived=gone)
        jobs.run_daily(open_hot(spark, hot), out, archived=gone)
        assert before == [table(spark, f"{out}/{n}") for n in names]


def test_a_machine_that_moves_leaves_no_row_behind(spark, readings, dims, tmp_path):
    out = str(tmp_path)
    jobs.run_minute_kpi(spark, readings, dims, AT, out)
    moved = {**dims, "dim_machine": dims["dim_machine"].withColumn("factory_id", F.lit("FCT9"))}
    jobs.run_minute_kpi(spark, readings, moved, AT, out)
    rows = spark.read.parquet(f"{out}/minute_kpi")
    assert rows.agg(F.sum("num_events")).first()[0] == 480
    assert {r[0] for r in rows.select("factory_id").distinct().collect()} == {"FCT9"}


def test_codes_that_collide_once_cleaned_count_once(spark, readings, dims, tmp_path):
    twice = dims["dim_machine"].unionAll(dims["dim_machine"].withColumn("machine_id", F.lower(F.concat(F.lit(" "), "machine_id"))))
    for limit in (0, 10**6):
        out = f"{tmp_path}/{limit}"
        jobs.run_minute_kpi(spark, readings, {**dims, "dim_machine": twice}, AT, out, normalise=True, max_bytes=limit)
        assert spark.read.parquet(f"{out}/minute_kpi").agg(F.sum("num_events")).first()[0] == 480


def test_filter_on_a_measure_means_the_same_for_large_dimensions(readings, enriched, dims):
    kpi = minute_kpi(enriched(readings))
    found = [
        sorted(map(repr, star.summarise(kpi, dims, ["criticality"], where=F.col("num_events") > 1, max_bytes=n).collect()))
        for n in (0, 10**6)
    ]
    assert found[0] == found[1]


def test_history_has_chunks_that_are_not_converted_yet(spark, readings, hot, tmp_path):
    archive = str(tmp_path / "archive")
    one = size_run(spark, hot, tmp_path, "one", chunk_docs=50, max_chunks=4)
    jobs.run_to_parquet(spark, one.files, archive)
    two = size_run(spark, hot, tmp_path, "two", chunk_docs=50, max_chunks=2)
    chunks = read_ndjson(spark, [one.files, two.files])
    assert ids(history(open_hot(spark, hot), read_archive(spark, archive), chunks)) == ids(readings)


def test_an_outlier_in_time_opens_its_own_hour_only(spark, make, readings, tmp_path):
    archive = str(tmp_path / "archive")
    archive_sink.append_archive(spark, readings, archive)
    odd = make({"_id": "old", "event_timestamp": "1970-01-01 00:00:00"}, {"_id": "new", "event_timestamp": "2024-01-01 11:59:59"})
    from plantpulse.sources.readings import touched_hours, with_archive_time

    past = read_archive(spark, archive).where(touched_hours(with_archive_time(odd), "event_ts"))
    assert past.count() == 240 and {r["hour"] for r in past.collect()} == {11}
    filters = past._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1]
    assert filters.startswith("[(isnull(year")


def test_store_reads_are_pruned_by_partition(spark, hot, dims):
    from plantpulse.operators.retention import newest_cutoff, older_than

    plan = older_than(open_hot(spark, hot), "2024-01-01 10:30:00")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("PartitionFilters: ")[1].startswith("[(isnull(event_date")
    assert newest_cutoff(open_hot(spark, hot), 15) == "2024-01-01 11:44:47"


def messages(spark, path, *batches):
    """A stream of one file per batch."""
    for n, rows in enumerate(batches):
        rows.coalesce(1).write.mode("append").json(f"{path}/{n}")
    return spark.readStream.schema(batches[0].schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(path)


def test_rows_without_identity_or_time_pass_the_dedup(spark, make, tmp_path):
    rows = make({"_id": None}, {"_id": None}, {"_id": "a"}, {"_id": "a"}, {"_id": "b", "event_timestamp": "bad"})
    stream = live.without_redeliveries(conform_readings(messages(spark, str(tmp_path / "in"), rows, rows)))
    live.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), cadence=None).awaitTermination()
    got = [r["_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert (got.count(None), got.count("a")) == (4, 1) and got.count("b") in (1, 2)


def test_dedup_and_kpi_in_one_stream(spark, readings, dims, tmp_path):
    from plantpulse.operators.conform import conform_machines, conform_sensors
    from plantpulse.operators.enrich import enrich

    stream = messages(spark, str(tmp_path / "in"), readings, readings)
    rows = live.without_redeliveries(conform_readings(stream))
    joined = enrich(rows, conform_machines(dims["dim_machine"]), conform_sensors(dims["dim_sensor_type"]))
    live.kpi_stream(joined, str(tmp_path / "kpi"), str(tmp_path / "ck"), None, lateness=None).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "kpi")).agg(F.sum("num_events"), F.max("kpi_minute_start_utc").cast("string")).first()
    assert got[0] == 436 and got[1] == "2024-01-01 11:48:00"  # minutes that are over, ten minutes before the newest


def test_live_kpis_with_copies_and_late_readings_equal_the_batch(spark, make, readings, dims, tmp_path):
    early, late = readings.where("_id >= 'r100'"), readings.where("_id < 'r120'")
    stream = messages(spark, str(tmp_path / "in"), early, late, make({"_id": None, "event_timestamp": "bad"}))
    out = str(tmp_path / "out")
    jobs.live_kpi(stream, dims, str(tmp_path / "hot"), out, str(tmp_path / "ck"), None).awaitTermination()
    jobs.run_minute_kpi(spark, readings, dims, AT, str(tmp_path / "batch"), normalise=True)
    assert table(spark, f"{out}/minute_kpi") == table(spark, f"{tmp_path}/batch/minute_kpi")
