import pytest
from pyspark.sql import functions as F

from plantpulse.operators import quality, star
from plantpulse.operators.conform import conform_machines, conform_readings
from plantpulse.plans import jobs
from plantpulse.session import shared_dir, work_path
from plantpulse.sinks.tables import append, open_table, replace_partitions, upsert

AS_OF = "2024-01-01 12:00:00"


def table(spark, path, *drop):
    return sorted(map(repr, spark.read.parquet(path).drop(*drop).collect()))


def test_upsert_replaces_by_key_with_nulls_equal(spark, tmp_path):
    path, ddl = str(tmp_path / "t"), "k string, p int, v int"
    keys, parts = ("k", "p"), ("p",)
    first = spark.createDataFrame([("a", 1, 1), (None, 1, 2), ("c", 2, 3), ("d", None, 4)], ddl)
    upsert(spark, first, path, keys, parts)
    upsert(spark, spark.createDataFrame([(None, 1, 20), ("e", 1, 5), ("d", None, 40)], ddl), path, keys, parts)
    got = sorted(map(str, (tuple(r) for r in spark.read.parquet(path).select("k", "p", "v").collect())))
    assert got == sorted(map(str, [("a", 1, 1), (None, 1, 20), ("e", 1, 5), ("c", 2, 3), ("d", None, 40)]))


def test_upsert_keeps_other_rows_of_a_null_partition_and_reads_no_other_days(spark, tmp_path):
    import glob

    path, ddl = str(tmp_path / "t"), "k string, d date, v int"
    days = "SELECT k, CAST(d AS date) AS d, v FROM VALUES ('a', NULL, 1), ('b', NULL, 2), ('c', '2024-01-01', 3), ('d', '2024-01-05', 4) AS t(k, d, v)"
    upsert(spark, spark.sql(days), path, ("k", "d"), ("d",))
    for f in glob.glob(f"{path}/d=2024-01-05/*.parquet"):
        kept = open(f, "rb").read()
        open(f, "w").write("no parquet")
        upsert(spark, spark.createDataFrame([("a", None, 10)], ddl), path, ("k", "d"), ("d",))
        upsert(spark, spark.sql("SELECT 'e' AS k, DATE'2024-01-01' AS d, 5 AS v"), path, ("k", "d"), ("d",))
        open(f, "wb").write(kept)
    got = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {"a": 10, "b": 2, "c": 3, "d": 4, "e": 5}


def test_replace_partitions_leaves_others_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    append(spark.createDataFrame([(1, 1), (2, 2)], "v int, p int"), path, ["p"])
    replace_partitions(spark.createDataFrame([(9, 2)], "v int, p int"), path, ["p"])
    assert sorted((r["p"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 9)]
    assert open_table(spark, str(tmp_path / "none"), spark.read.parquet(path).schema) is None


def test_work_paths_lie_below_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    a, b = work_path(spark, "x"), work_path(spark, "x")
    assert a != b and a.startswith(shared_dir(spark))


@pytest.fixture
def raw(make):
    rows = [
        {"_id": f"r{i}", "machine_id": f"MAC{i % 2 + 1}", "product_id": None if i % 5 == 0 else i % 3,
         "event_timestamp": f"2024-01-01 {8 + i // 60:02d}:{i % 60:02d}:{i % 7:02d}",
         "reading_value": float(i % 40), "is_downtime": i % 11 == 0}
        for i in range(200)
    ]
    return make(*rows)


def test_minute_kpi_job_twice_gives_the_same_tables(spark, raw, dims, tmp_path):
    out = str(tmp_path)
    jobs.run_minute_kpi(spark, raw, dims, AS_OF, out)
    first = [table(spark, f"{out}/{t}") for t in ("minute_kpi", "alert_events")]
    jobs.run_minute_kpi(spark, raw, dims, AS_OF, out)
    assert first == [table(spark, f"{out}/{t}") for t in ("minute_kpi", "alert_events")]
    kpi, alerts = spark.read.parquet(f"{out}/minute_kpi"), spark.read.parquet(f"{out}/alert_events")
    assert kpi.agg(F.sum("num_events")).first()[0] == 200
    assert kpi.agg(F.sum("num_alerts")).first()[0] == alerts.count() > 0


def test_minute_kpi_job_keeps_history_that_left_the_hot_store(spark, raw, dims, tmp_path):
    out = str(tmp_path)
    jobs.run_minute_kpi(spark, raw, dims, AS_OF, out)
    before = table(spark, f"{out}/minute_kpi")
    later = raw.where("event_timestamp >= '2024-01-01 10:00:00'")
    jobs.run_minute_kpi(spark, later, dims, AS_OF, out, lookback=120)
    assert table(spark, f"{out}/minute_kpi") == before


def test_minute_tables_job_twice(spark, raw, dims, tmp_path):
    out = str(tmp_path)
    names = [f"agg_{level}_minute" for level in ("overall", "factory", "machine", "product")]
    names.append("fact_machine_alert_events")
    jobs.run_minute_tables(spark, raw, dims, AS_OF, out)
    first = {n: table(spark, f"{out}/{n}") for n in names}
    jobs.run_minute_tables(spark, raw, dims, AS_OF, out)
    assert first == {n: table(spark, f"{out}/{n}") for n in names}
    totals = {n: spark.read.parquet(f"{out}/{n}").agg(F.sum("event_count")).first()[0] for n in names[:4]}
    assert totals["agg_overall_minute"] == totals["agg_factory_minute"] == totals["agg_machine_minute"] == 200
    assert totals["agg_product_minute"] == raw.where("product_id is not null").count()


@pytest.mark.parametrize("job", [jobs.run_minute_kpi, jobs.run_minute_tables])
def test_jobs_with_a_large_machine_table_give_the_same_tables(spark, raw, dims, tmp_path, job):
    for name, limit in (("small", 10**6), ("large", 0)):
        job(spark, raw, dims, AS_OF, f"{tmp_path}/{name}", max_bytes=limit)
    names = sorted(p.name for p in (tmp_path / "small").iterdir())
    assert names == sorted(p.name for p in (tmp_path / "large").iterdir())
    for n in names:
        small, large = (spark.read.parquet(f"{tmp_path}/{side}/{n}") for side in ("small", "large"))
        assert sorted(map(repr, small.collect())) == sorted(map(repr, large.select(small.columns).collect()))


def test_summary_with_large_dimensions_is_the_same(spark, make, enriched, dims):
    from plantpulse.operators.kpi import minute_kpi

    rows = [{"machine_id": f"MAC{i % 2 + 1}", "reading_value": float(i), "event_timestamp": f"2024-01-01 10:0{i % 5}:00"}
            for i in range(40)]
    kpi = minute_kpi(enriched(make(*rows)))
    args = (kpi, dims, ["criticality", "product_id"])
    options = {"where": F.col("sensor_type_name") == "Temperature", "where_on": ["sensor_type_name"]}
    small = star.summarise(*args, **options)
    large = star.summarise(*args, **options, max_bytes=0)
    assert sorted(map(repr, small.collect())) == sorted(map(repr, large.select(small.columns).collect()))
    assert small.agg(F.sum("num_events")).first()[0] == 40


def test_daily_job(spark, raw, tmp_path):
    jobs.run_daily(raw, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/daily_machine").agg(F.sum("total_readings")).first()[0] == 200


def test_quality_report_counts_before_filtering(make, dims):
    raw = make(
        {}, {"event_timestamp": "bad"}, {"event_timestamp": None}, {"machine_id": "MAC9"}, {"reading_value": None},
        {"reading_value": float("nan"), "product_id": None, "operator_id": None},
        {"event_timestamp": "2023-01-01 00:00:00"},
    )
    row = quality.quality_report(conform_readings(raw), conform_machines(dims["dim_machine"]), AS_OF, 6000).first()
    assert row.asDict() == {
        "total_rows": 7, "unparsed_time": 2, "missing_value": 1, "nan_value": 1, "missing_product": 1,
        "missing_operator": 1, "in_lookback": 4, "matched": 3, "unmatched": 1,
    }


def test_unmatched_counts_null_codes_and_machines_without_factory(make, dims):
    raw = make({"machine_id": None}, {"machine_id": "MAC3"}, {"machine_id": "MAC3"}, {"machine_id": "MAC8"}, {})
    rows = quality.unmatched_machines(conform_readings(raw), conform_machines(dims["dim_machine"])).collect()
    assert [tuple(r) for r in rows] == [("MAC3", 2), (None, 1), ("MAC8", 1)]


def test_orphans(make, dims):
    raw = make({"machine_id": "MAC9"}, {"machine_id": "MAC9"}, {"sensor_type_id": 77}, {"machine_id": None})
    rows = quality.orphan_keys(
        conform_readings(raw), {"machine_id": dims["dim_machine"], "sensor_type_id": dims["dim_sensor_type"]}
    ).collect()
    assert sorted(tuple(r) for r in rows) == [("machine_id", 1, 2), ("sensor_type_id", 1, 1)]


def test_star_joins_only_the_dimensions_it_needs(spark, make, enriched, dims):
    from plantpulse.operators.kpi import minute_kpi

    rows = star.summarise(
        minute_kpi(enriched(make({}, {"machine_id": "MAC2"}, {"machine_id": "MAC2"}))),
        {"dim_machine": dims["dim_machine"]}, ["criticality"], having=F.col("num_events") > 1,
    ).collect()
    assert [(r["criticality"], r["num_events"]) for r in rows] == [("Low", 2)]
