"""The query catalog: every operator run on the test tables, by name.

Each query takes the session and a folder of tables. Averages are rounded to six places, as two
engines add doubles in different orders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.operators import alerts, kpi, quality, retention, star
from plantpulse.operators.conform import (
    conform_machines,
    conform_readings,
    conform_sensors,
    within_lookback,
)
from plantpulse.operators.enrich import enrich
from plantpulse.plans.jobs import (
    ArchiveResult,
    enriched_readings,
    live_alerts,
    live_kpi,
    run_age_dump,
    run_minute_kpi,
    run_size_archive,
    run_to_parquet,
)
from plantpulse.plans.incremental import run_incremental_kpi
from plantpulse.plans.late import replay_late
from plantpulse.plans.publish import read_kpi_table
from plantpulse.plans.rollups import refresh_rollups, summarise_rolled
from plantpulse.plans.sketches import refresh_sketches
from plantpulse.plans.sketches import top_unmatched as top_unmatched_codes
from plantpulse.schemas import MANIFEST, READING
from plantpulse.session import use_utc, work_path
from plantpulse.sinks.archive import archive_layout, write_chunks, write_snapshot
from plantpulse.sinks.hot import compact_hot, delete_hot, hot_version, newest_second, open_hot, write_hot_batch
from plantpulse.sinks.tables import swap_partitions
from plantpulse.sources import testdata as td
from plantpulse.sources.dimensions import read_csv, read_json_records
from plantpulse.sources.readings import (
    archived_readings,
    decode_messages,
    find_readings,
    history,
    read_archive,
    read_ndjson,
    store_bytes,
    unique_readings,
)
from plantpulse.sources.snapshots import dimension_source, publish_dimension
from plantpulse.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# Parameters of the archive queries, shared with their SQL.
RUN_ID = "20240101T020000Z_fixture"
KEEP_MINUTES = 15
ALL_POLICY = retention.SizePolicy(threshold_mb=0)
SIZE_POLICY = retention.SizePolicy(threshold_mb=1)
RUN_POLICY = retention.SizePolicy(threshold_mb=0, chunk_docs=250, max_chunks=10)
READ_START, READ_END = "2024-01-01 00:20:00", "2024-01-01 01:10:00"
READ_FACTORIES = ["FCT003", "FCT007", "FCT011"]
BI_START, BI_END = "2024-01-01 00:40:00", "2024-01-01 01:50:00"
STAR_ATTRIBUTES = [
    "city", "country", "capacity_class", "line_name", "criticality", "experience_level",
    "shift_pattern", "category", "brand", "sensor_type_name",
]


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _conformed(spark: SparkSession, sf: str, normalise: bool = True) -> DataFrame:
    return conform_readings(td.readings(spark, sf), normalise=normalise)


def _recent(spark: SparkSession, sf: str, normalise: bool = True) -> DataFrame:
    return within_lookback(_conformed(spark, sf, normalise), td.AS_OF, td.LOOKBACK)


def _machines(spark: SparkSession, sf: str, normalise: bool = True) -> DataFrame:
    return conform_machines(td.dim_machine(spark, sf), normalise=normalise)


def _enriched(spark: SparkSession, sf: str, normalise: bool = True) -> DataFrame:
    dims = {"dim_machine": td.dim_machine(spark, sf), "dim_sensor_type": td.dim_sensor_type(spark)}
    return enriched_readings(td.readings(spark, sf), dims, td.AS_OF, td.LOOKBACK, normalise=normalise)


def _kpi(spark: SparkSession, sf: str) -> DataFrame:
    return kpi.minute_kpi(_enriched(spark, sf))


# --- conforming and enrichment -------------------------------------------------------------------


@query
def readings_conformed(spark: SparkSession, sf: str) -> DataFrame:
    return _conformed(spark, sf)


@query
def readings_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Every reading delivered twice, then each identity once."""
    raw = td.readings(spark, sf)
    return unique_readings(raw.unionAll(raw))


@query
def events_enriched(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf)


# --- KPIs and alerts -----------------------------------------------------------------------------


@query
def minute_kpi(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_kpi(spark, sf), "avg_reading")


@query
def minute_kpi_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Machine codes as they come, and no alerts shown in rows with a NULL key."""
    return _rounded(kpi.minute_kpi(_enriched(spark, sf, False), count_null_keys=False), "avg_reading")


@query
def minute_kpi_downtime_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(kpi.minute_kpi(_enriched(spark, sf), downtime_estimate=True), "avg_reading")


@query
def alerts_per_minute(spark: SparkSession, sf: str) -> DataFrame:
    return kpi.alerts_per_minute(alerts.threshold_alerts(_enriched(spark, sf, False), "kpi"))


@query
def alerts_a(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.threshold_alerts(_enriched(spark, sf), "machine")


@query
def alerts_b(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.threshold_alerts(_enriched(spark, sf, False), "kpi")


@query
def agg_overall_minute(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(kpi.minute_stats(_enriched(spark, sf), "overall"), "avg_value")


@query
def agg_factory_minute(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(kpi.minute_stats(_enriched(spark, sf), "factory"), "avg_value")


@query
def agg_machine_minute(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(kpi.minute_stats(_enriched(spark, sf), "machine"), "avg_value")


@query
def agg_product_minute(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(kpi.minute_stats(_enriched(spark, sf), "product"), "avg_value")


@query
def agg_minute_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(kpi.minute_stats_all_levels(_enriched(spark, sf)), "avg_value")


@query
def daily_machine(spark: SparkSession, sf: str) -> DataFrame:
    raw = td.readings(spark, sf, fold=False)
    return _rounded(kpi.daily_machine(conform_readings(raw, normalise=False)), "avg_reading")


@query
def kpi_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return kpi.freshness(_kpi(spark, sf))


@query
def kpi_table_range(spark: SparkSession, sf: str) -> DataFrame:
    """The KPI table as the job stores it, read back for a time range."""
    out = work_path(spark, "tables")
    run_minute_kpi(
        spark, td.readings(spark, sf), td.dimensions(spark, sf), td.AS_OF, out, td.LOOKBACK, normalise=True
    )
    return _rounded(read_kpi_table(spark, f"{out}/minute_kpi", BI_START, BI_END), "avg_reading")


# --- data quality --------------------------------------------------------------------------------


@query
def dq_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_report(_conformed(spark, sf), _machines(spark, sf), td.AS_OF, td.LOOKBACK)


@query
def dq_orphans(spark: SparkSession, sf: str) -> DataFrame:
    dims = {
        "machine_id": _machines(spark, sf),
        "operator_id": td.dim_operator(spark, sf),
        "product_id": td.dim_product(spark, sf),
        "sensor_type_id": td.dim_sensor_type(spark),
    }
    return quality.orphan_keys(_conformed(spark, sf), dims)


@query
def top_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return quality.unmatched_machines(_recent(spark, sf), _machines(spark, sf))


@query
def top_unmatched_sketched(spark: SparkSession, sf: str) -> DataFrame:
    """The same ranking over a hot store, from sketches per hour and an exact count of the candidates."""
    hot, path = _hot(spark, sf), work_path(spark, "sketches")
    refresh_sketches(spark, hot, path)
    readings = within_lookback(conform_readings(open_hot(spark, hot)), td.AS_OF, td.LOOKBACK)
    return top_unmatched_codes(spark, path, readings, _machines(spark, sf))


@query
def dim_preview(spark: SparkSession, sf: str) -> DataFrame:
    return quality.first_machines(_machines(spark, sf))


@query
def latest_events(spark: SparkSession, sf: str) -> DataFrame:
    return quality.newest_readings(_recent(spark, sf))


@query
def max_event_ts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.newest_event_time(_conformed(spark, sf))


# --- dashboards ----------------------------------------------------------------------------------


@query
def bi_star(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(star.star(_kpi(spark, sf), td.dimensions(spark, sf), STAR_ATTRIBUTES), "avg_reading")


@query
def bi_city_capacity(spark: SparkSession, sf: str) -> DataFrame:
    rows = star.between(_kpi(spark, sf), BI_START, BI_END)
    return star.summarise(
        rows, td.dimensions(spark, sf), ["city", "capacity_class"], having=F.col("num_events") > 10
    )


@query
def bi_operator_shift(spark: SparkSession, sf: str) -> DataFrame:
    return star.summarise(_kpi(spark, sf), td.dimensions(spark, sf), ["experience_level", "shift_pattern"])


@query
def bi_product_category(spark: SparkSession, sf: str) -> DataFrame:
    return star.summarise(_kpi(spark, sf), td.dimensions(spark, sf), ["category", "brand"])


@query
def bi_machine_criticality(spark: SparkSession, sf: str) -> DataFrame:
    return star.summarise(
        _kpi(spark, sf),
        td.dimensions(spark, sf),
        ["criticality", "machine_type"],
        where=F.col("capacity_class") != "Pilot",
        where_on=["capacity_class"],
    )


@query
def bi_rolled(spark: SparkSession, sf: str) -> DataFrame:
    """``bi_city_capacity`` from half past midnight on: a whole hour from hour sums, half an hour from the KPI table."""
    out, start = work_path(spark, "rollups"), "2024-01-01 00:30:00"
    swap_partitions(live.kpi_table_rows(_kpi(spark, sf)), f"{out}/minute_kpi", live.KPI_TABLE_PARTITIONS)
    refresh_rollups(spark, out)
    return summarise_rolled(
        spark, out, td.dimensions(spark, sf), ["city", "capacity_class"], start=start, having=F.col("num_events") > 10
    )


@query
def bi_downtime_having(spark: SparkSession, sf: str) -> DataFrame:
    return star.summarise(
        _kpi(spark, sf),
        td.dimensions(spark, sf),
        ["country", "line_name", "sensor_type_name"],
        having=(F.col("unplanned_downtime") > 0) & (F.col("num_alerts") > 0),
    )


@query
def bi_alert_severity(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts by severity, sensor and city; counted before the join."""
    counted = alerts.threshold_alerts(_enriched(spark, sf), "kpi").groupBy(
        "severity", "sensor_type_id", "factory_id"
    ).agg(F.count(F.lit(1)).alias("n"), F.max("actual_value").alias("hi"), F.min("actual_value").alias("lo"))
    joined = star.star(counted, td.dimensions(spark, sf), ["city", "sensor_type_name"])
    return joined.groupBy("severity", "sensor_type_name", "city").agg(
        F.sum("n").alias("num_alerts"), F.max("hi").alias("max_value"), F.min("lo").alias("min_value")
    )


# --- archive -------------------------------------------------------------------------------------


def _cutoff(raw: DataFrame) -> str:
    return retention.newest_cutoff(raw, KEEP_MINUTES)


def _leaving(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    raw = td.readings(spark, sf)
    cutoff = _cutoff(raw)
    return retention.older_than(raw, cutoff), cutoff


@query
def archive_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _leaving(spark, sf)[0]


@query
def archive_candidates_clock(spark: SparkSession, sf: str) -> DataFrame:
    return retention.older_than(td.readings(spark, sf), retention.age_cutoff(td.AS_OF))


@query
def archive_run_batch(spark: SparkSession, sf: str) -> DataFrame:
    """What one capped run takes: the oldest readings first."""
    return retention.oldest(_leaving(spark, sf)[0], RUN_POLICY.run_cap)


@query
def retention_remaining(spark: SparkSession, sf: str) -> DataFrame:
    """What is left once all candidates have gone."""
    return retention.remaining(td.readings(spark, sf), _leaving(spark, sf)[0])


def _hot(spark: SparkSession, sf: str) -> str:
    """All readings in a hot store of two ingest batches, rows without time included."""
    raw, path = td.readings(spark, sf), work_path(spark, "hot")
    odd = F.crc32(F.col("_id").cast("binary")) % 2 == 1
    write_hot_batch(raw.where(odd), path, "a-0")
    write_hot_batch(raw.where(~odd), path, "a-1")
    return path


def _size_run(spark: SparkSession, hot: str, policy: retention.SizePolicy) -> tuple[ArchiveResult, str]:
    """The real job, called twice as after a lost scheduler; its result and the folder of manifests."""
    archive, manifests = work_path(spark, "chunks"), work_path(spark, "manifests")
    args = {"run_id": RUN_ID, "archived_at": td.AS_OF, "policy": policy}
    first = run_size_archive(spark, hot, archive, manifests, **args)
    again = run_size_archive(spark, hot, archive, manifests, **args)
    if first != again:
        raise RuntimeError(f"{first} != {again}")
    return first, manifests


@query
def archive_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of a real run that takes all candidates, without the paths."""
    _, manifests = _size_run(spark, _hot(spark, sf), ALL_POLICY)
    return spark.read.schema(MANIFEST).json(f"{manifests}/run_id={RUN_ID}").drop("data_paths", "run_id").select(
        F.lit(RUN_ID).alias("run_id"), "*"
    )


def _run_counts(spark: SparkSession, hot: str, result: ArchiveResult) -> DataFrame:
    stored = read_ndjson(spark, result.files)
    counts = open_hot(spark, hot).agg(F.count(F.lit(1)).alias("hot_rows"))
    return counts.select(
        F.lit(result.docs_archived).cast("bigint").alias("docs_archived"),
        F.lit(result.docs_deleted).cast("bigint").alias("docs_deleted"),
        F.lit(result.docs_left).cast("bigint").alias("docs_left"),
        F.lit(stored.select("_id").distinct().count()).cast("bigint").alias("stored_ids"),
        "hot_rows",
    )


@query
def size_archive_run(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a run of the real job, without a cap, on a hot store of files."""
    hot = _hot(spark, sf)
    return _run_counts(spark, hot, _size_run(spark, hot, ALL_POLICY)[0])


@query
def age_dump_run(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a run of the real dump job, called twice."""
    hot, dumps = _hot(spark, sf), work_path(spark, "dumps")
    for _ in range(2):
        result = run_age_dump(spark, hot, dumps, run_id=RUN_ID, as_of=td.AS_OF)
    return _run_counts(spark, hot, result)


@query
def kpi_after_archive(spark: SparkSession, sf: str) -> DataFrame:
    """The KPI table after KPI run, archive run and KPI run: as if nothing had been archived."""
    hot, out, dims = _hot(spark, sf), work_path(spark, "tables"), td.dimensions(spark, sf)
    args = (dims, td.AS_OF, out, td.LOOKBACK)
    run_minute_kpi(spark, open_hot(spark, hot), *args, normalise=True)
    result, _ = _size_run(spark, hot, ALL_POLICY)
    gone = archived_readings(spark, chunks=[result.files])
    run_minute_kpi(spark, open_hot(spark, hot), *args, normalise=True, archived=gone)
    table = spark.read.parquet(f"{out}/minute_kpi").drop("kpi_date", "kpi_hour")
    return _rounded(table, "avg_reading")


def _hundredth(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("_id").cast("bigint") % 100 == 0)


@query
def hot_snapshot_read(spark: SparkSession, sf: str) -> DataFrame:
    """All readings as a version before a delete shows them, and whether the present one still has them."""
    hot = _hot(spark, sf)
    before = hot_version(spark, hot)
    delete_hot(spark, hot, _hundredth(td.readings(spark, sf)), keep_minutes=60)
    now = open_hot(spark, hot).select("_id", F.lit(True).alias("kept"))
    old = open_hot(spark, hot, before).select(*READING.fieldNames()).join(now, "_id", "left")
    return old.withColumn("kept", F.coalesce("kept", F.lit(False)))


@query
def hot_merge_on_read(spark: SparkSession, sf: str) -> DataFrame:
    """What is left after a delete of every hundredth reading that wrote identities only."""
    hot = _hot(spark, sf)
    delete_hot(spark, hot, _hundredth(td.readings(spark, sf)))
    return open_hot(spark, hot).select(*READING.fieldNames())


@query
def hot_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """The same after the lists of deleted readings have been folded in."""
    hot = _hot(spark, sf)
    delete_hot(spark, hot, _hundredth(td.readings(spark, sf)))
    compact_hot(spark, hot)
    return open_hot(spark, hot).select(*READING.fieldNames())


@query
def dim_csv_load(spark: SparkSession, sf: str) -> DataFrame:
    """The machine table written as CSV with a header and loaded."""
    path = work_path(spark, "dim")
    td.dim_machine(spark, sf).write.option("header", True).csv(path)
    return read_csv(spark, "dim_machine", path).select("machine_id", "factory_id", "line_name", "criticality")


@query
def dim_json_load(spark: SparkSession, sf: str) -> DataFrame:
    """The product table written as JSON arrays of records, one file per thousand products, and loaded."""
    path, block = work_path(spark, "dim"), F.floor(F.col("product_id") / 1000).alias("block")
    records = td.dim_product(spark, sf).groupBy(block).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    records.write.partitionBy("block").text(path)
    return read_json_records(spark, "dim_product", path).select("product_id", "category", "brand")


@query
def store_size(spark: SparkSession, sf: str) -> DataFrame:
    """Size and policy of a store of JSON lines, whose bytes are those of its texts."""
    path = work_path(spark, "store")
    td.readings(spark, sf).select(F.concat_ws(",", "_id", "machine_id", "event_timestamp").alias("value")).write.text(path)
    size = store_bytes(spark, path, "*.txt").select("bytes")
    (found,) = size.first()
    return size.select("bytes", F.lit(SIZE_POLICY.due(found)).alias("due"))


@query
def archive_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a run: rows in the hot store before, selected, written and left."""
    path = work_path(spark, "readings")
    td.readings(spark, sf).write.parquet(path)
    raw = spark.read.schema(READING).parquet(path)
    leaving = retention.older_than(raw, _cutoff(raw))
    stored = read_ndjson(spark, write_chunks(leaving, work_path(spark, "chunks"), RUN_ID, max_files=None))
    side = [
        df.select(F.lit(name).alias("side"))
        for name, df in {
            "before": raw, "selected": leaving, "written": stored, "left": retention.remaining(raw, stored)
        }.items()
    ]
    rows = side[0].unionAll(side[1]).unionAll(side[2]).unionAll(side[3])
    count = {s: F.count_if(F.col("side") == s) for s in ("before", "selected", "written", "left")}
    return rows.agg(
        *[c.alias(f"docs_{s}") for s, c in count.items()],
        ((count["selected"] == count["written"]) & (count["before"] == count["written"] + count["left"])).alias("balanced"),
    )


@query
def archive_ndjson_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All readings as JSON lines and back."""
    return read_ndjson(spark, write_snapshot(td.readings(spark, sf), work_path(spark, "dump"), RUN_ID))


def _archived(spark: SparkSession, sf: str) -> str:
    dump = write_snapshot(td.readings(spark, sf), work_path(spark, "dump"), RUN_ID)
    path = work_path(spark, "archive")
    run_to_parquet(spark, dump, path)
    return path


@query
def archive_layout_columns(spark: SparkSession, sf: str) -> DataFrame:
    return archive_layout(td.readings(spark, sf))


@query
def archive_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """All readings dumped, converted to the columnar archive and read back."""
    return read_archive(spark, _archived(spark, sf))


@query
def archive_read_pruned(spark: SparkSession, sf: str) -> DataFrame:
    return read_archive(
        spark, _archived(spark, sf), start=READ_START, end=READ_END, factories=READ_FACTORIES
    )


@query
def archive_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Archived readings of a few identities, found through the Bloom filters of the files."""
    wanted = td.readings(spark, sf).where(F.col("_id").cast("bigint") % 997 == 0).select("_id")
    return find_readings(read_archive(spark, _archived(spark, sf)), wanted)


@query
def hot_newest(spark: SparkSession, sf: str) -> DataFrame:
    """Newest event time of a hot store, from footers, and the cutoff of an archive run."""
    newest = newest_second(spark, _hot(spark, sf))
    row = (newest, retention.cutoff_before(newest, KEEP_MINUTES))
    return spark.createDataFrame([row], "newest_second bigint, cutoff string")


@query
def history_union(spark: SparkSession, sf: str) -> DataFrame:
    """Hot store, columnar archive and JSON lines together: some readings are in two of them, some in one alone."""
    raw = td.readings(spark, sf)
    leaving, cutoff = _leaving(spark, sf)
    part = F.crc32(F.col("_id").cast("binary")) % 3
    dump = write_snapshot(leaving.where(part == 0), work_path(spark, "dump"), RUN_ID)
    more = write_snapshot(leaving.where(part <= 1), work_path(spark, "dump"), RUN_ID)
    path = work_path(spark, "archive")
    run_to_parquet(spark, dump, path)
    hot = raw.where(F.coalesce(F.col("event_timestamp") >= cutoff, F.lit(True)) | (part == 2) | (part == 0))
    return history(hot, read_archive(spark, path), read_ndjson(spark, more))


@query
def kpi_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """KPIs after three runs over new batches alone, an archive run and a compaction among them."""
    raw, dims = td.readings(spark, sf), td.dimensions(spark, sf)
    hot, out = work_path(spark, "hot"), work_path(spark, "tables")
    part = F.crc32(F.col("_id").cast("binary")) % 3
    for number in range(3):
        write_hot_batch(raw.where(part == number), hot, f"a-{number}", keep_minutes=60)
        run_incremental_kpi(spark, hot, dims, out, normalise=True)
        if number == 1:
            _size_run(spark, hot, ALL_POLICY)
            compact_hot(spark, hot, most_files=0, keep_minutes=60)
    start = F.lit(td.AS_OF).cast("timestamp") - F.make_interval(mins=F.lit(td.LOOKBACK))
    table = spark.read.parquet(f"{out}/minute_kpi").where(F.col("kpi_minute_start_utc") >= start)
    return _rounded(table.drop("kpi_date", "kpi_hour"), "avg_reading")


# --- streams -------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """Raw readings, arriving as rows of the events table."""
    events = use_utc(spark).readStream.schema(td.TABLES["events"]).option("pathGlobFilter", "events.parquet").parquet(sf)
    return td.readings_from(events)


def _recent_stream(spark: SparkSession, sf: str) -> DataFrame:
    return within_lookback(conform_readings(_stream(spark, sf)), td.AS_OF, td.LOOKBACK)


def _enriched_stream(spark: SparkSession, sf: str) -> DataFrame:
    return enrich(_recent_stream(spark, sf), _machines(spark, sf), conform_sensors(td.dim_sensor_type(spark)))


def _drained(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Run a stream over what is there and read back what it wrote."""
    out = work_path(spark, "stream")
    live.append_stream(rows, f"{out}/table", f"{out}/checkpoint", cadence=None).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/table")


@query
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Readings as JSON messages, decoded, conformed and stored."""
    messages = _stream(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    return _drained(spark, conform_readings(decode_messages(messages)))


@query
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every reading delivered twice, stored once."""
    twice = _stream(spark, sf).unionAll(_stream(spark, sf))
    return _drained(spark, live.without_redeliveries(conform_readings(twice)))


@query
def stream_enriched(spark: SparkSession, sf: str) -> DataFrame:
    return _drained(spark, _enriched_stream(spark, sf))


@query
def stream_minute_kpi(spark: SparkSession, sf: str) -> DataFrame:
    out = work_path(spark, "stream")
    rows = _enriched_stream(spark, sf)
    live.kpi_stream(rows, f"{out}/table", f"{out}/checkpoint", cadence=None).awaitTermination()
    table = spark.read.parquet(f"{out}/table").drop("kpi_date", "kpi_hour")
    return _rounded(table, "avg_reading")


@query
def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    out = work_path(spark, "stream")
    rows = alerts.threshold_alerts(_enriched_stream(spark, sf), "kpi", with_reading_id=True)
    live.alert_stream(rows, f"{out}/table", f"{out}/checkpoint", cadence=None).awaitTermination()
    return spark.read.parquet(f"{out}/table").drop("alert_date", "alert_hour")


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Readings as messages of a topic; every 17th is cut off, every 19th has a word for its value."""
    number = F.col("_id").cast("bigint")
    rows = _stream(spark, sf).withColumn("n", number)
    fields = [F.when(number % 19 == 0, F.lit("many")).otherwise(F.col(c).cast("string")).alias(c) if c == "reading_value" else F.col(c)
              for c in READING.fieldNames()]
    whole = F.to_json(F.struct(*fields))
    value = F.when(number % 17 == 0, F.substr(whole, F.lit(1), F.lit(20))).otherwise(whole)
    # a number in quotes would be mistyped too
    bare = F.regexp_replace(value, '"reading_value":"(-?[0-9][^"]*)"', '"reading_value":$1')
    return rows.select(bare.alias("value"), F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("n").alias("offset"))


@query
def dq_corrupt(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of a stream that were stored as readings, and dead letters by fault, with their places in the topic."""
    out = work_path(spark, "messages")
    live.store_messages(_messages(spark, sf), f"{out}/hot", f"{out}/dead", f"{out}/checkpoint", cadence=None).awaitTermination()
    stored = open_hot(spark, f"{out}/hot").select(F.lit("stored").alias("kind"), F.col("_id").cast("bigint").alias("offset"))
    dead = spark.read.parquet(f"{out}/dead").select(F.col("fault").alias("kind"), "offset")
    return stored.unionAll(dead).groupBy("kind").agg(
        F.count(F.lit(1)).alias("messages"), F.min("offset").alias("first_offset"), F.sum("offset").alias("offsets")
    )


_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def _fed(raw: DataFrame, part: Column, parts: int, path: str) -> Iterator[DataFrame]:
    """``raw`` put into folders below ``path``, one for each value of ``part``, and after each the stream of them.

    A stream that is run, from its checkpoint, until it stops takes the new folder as one micro-batch, however many
    files it has; so all tasks write and read it. No batch without rows comes between, which would move the watermark on.
    """
    spark = raw.sparkSession
    before = spark.conf.get(_EMPTY_BATCHES)
    spark.conf.set(_EMPTY_BATCHES, "false")
    try:
        for number in range(parts):
            raw.where(part == number).write.parquet(f"{path}/{number}")
            yield spark.readStream.schema(READING).option("recursiveFileLookup", "true").parquet(path)
    finally:
        spark.conf.set(_EMPTY_BATCHES, before)


@query
def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """KPIs of a stream with a watermark whose last batch comes too late, after the late readings were replayed."""
    raw, dims, out = td.readings(spark, sf), td.dimensions(spark, sf), work_path(spark, "late")
    part = F.when(F.crc32(F.col("_id").cast("binary")) % 10 == 0, 2).otherwise(F.crc32(F.col("_id").cast("binary")) % 2)
    for feed in _fed(raw, part, 3, f"{out}/feed"):
        live.store_stream(feed, f"{out}/hot", f"{out}/stored", cadence=None).awaitTermination()
        rows = enrich(conform_readings(feed), conform_machines(dims["dim_machine"]), conform_sensors(dims["dim_sensor_type"]))
        live.kpi_stream(rows, f"{out}/tables/minute_kpi", f"{out}/counted", cadence=None).awaitTermination()
    replay_late(spark, f"{out}/hot", dims, f"{out}/tables")
    start = F.lit(td.AS_OF).cast("timestamp") - F.make_interval(mins=F.lit(td.LOOKBACK))
    table = spark.read.parquet(f"{out}/tables/minute_kpi").where(F.col("kpi_minute_start_utc") >= start)
    return _rounded(table.drop("kpi_date", "kpi_hour"), "avg_reading")


@query
def stream_dimension_change(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts of a stream whose machines all belong to one factory in the first batch and to their own in the second."""
    raw, out = td.readings(spark, sf), work_path(spark, "moving")
    machines = td.dim_machine(spark, sf)
    publish_dimension(td.dim_sensor_type(spark), f"{out}/dims", "dim_sensor_type")
    publish_dimension(machines.withColumn("factory_id", F.lit("FCT999")), f"{out}/dims", "dim_machine")
    known = dimension_source(spark, f"{out}/dims")
    asked: list[int] = []

    def now() -> dict[str, DataFrame]:
        if asked:  # between the first batch and the second
            publish_dimension(machines, f"{out}/dims", "dim_machine")
        asked.append(1)
        return known()

    for feed in _fed(raw, F.col("_id").cast("bigint") % 2, 2, f"{out}/feed"):
        live_alerts(feed, now, f"{out}/alerts", f"{out}/checkpoint", cadence=None).awaitTermination()
    start = F.lit(td.AS_OF).cast("timestamp") - F.make_interval(mins=F.lit(td.LOOKBACK))
    return spark.read.parquet(f"{out}/alerts").where(F.col("alert_time_utc") >= start).drop("alert_date", "alert_hour")


@query
def stream_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Messages, some delivered twice and some without identity, through the hot store into the KPI table."""
    nameless = F.col("_id").cast("bigint") % 13 == 0
    once = _stream(spark, sf).withColumn("_id", F.when(~nameless, F.col("_id")))
    messages = once.unionAll(_stream(spark, sf).where(~nameless)).select(F.to_json(F.struct("*")).alias("value"))
    out = work_path(spark, "chain")
    run = live_kpi(
        decode_messages(messages), td.dimensions(spark, sf), f"{out}/hot", f"{out}/tables", f"{out}/checkpoint", cadence=None
    )
    run.awaitTermination()
    start = F.lit(td.AS_OF).cast("timestamp") - F.make_interval(mins=F.lit(td.LOOKBACK))
    table = spark.read.parquet(f"{out}/tables/minute_kpi").where(F.col("kpi_minute_start_utc") >= start)
    return _rounded(table.drop("kpi_date", "kpi_hour"), "avg_reading")

