"""Archive files: chunked JSON lines, snapshots, partitioned Parquet, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.constants import ARCHIVE_CHUNK_DOCS, ARCHIVE_MAX_CHUNKS
from plantpulse.functions.timing import calendar_parts
from plantpulse.operators.lookup import without_identities
from plantpulse.schemas import READING
from plantpulse.sinks.tables import append, bloom_options, open_table
from plantpulse.sources.readings import (
    ARCHIVE_PARTITIONS,
    read_archive,
    read_ndjson,
    touched_hours,
    unique_readings,
    with_archive_time,
)


#: Files of a run that its manifest names one by one.
LISTED_PATHS = 10_000


def run_path(root: str, run_id: str) -> str:
    return f"{root.rstrip('/')}/run_id={run_id}"


def write_chunks(
    readings: DataFrame,
    root: str,
    run_id: str,
    chunk_docs: int = ARCHIVE_CHUNK_DOCS,
    max_files: int | None = ARCHIVE_MAX_CHUNKS,
) -> str:
    """JSON lines of one run, at most ``chunk_docs`` per file; the same run replaces its own files.

    With ``max_files``, for runs capped at as many chunks, the rows, which must be staged so that they are the same
    each time they are read, are numbered across tasks and cut into full chunks: no file is left half full.
    """
    target = run_path(root, run_id)
    rows = readings.select(*READING.fieldNames())
    if max_files is not None:
        rows = _dealt(rows, chunk_docs)
    rows.write.mode("overwrite").option("maxRecordsPerFile", chunk_docs).option("ignoreNullFields", False).json(target)
    return target


def _dealt(rows: DataFrame, chunk_docs: int) -> DataFrame:
    """Chunks of exactly ``chunk_docs`` rows but for the last, each one task of its own."""
    place = F.monotonically_increasing_id()  # task and place within it
    numbered = rows.withColumns({"_task": F.shiftright(place, 33), "_row": place.bitwiseAND((1 << 33) - 1)})
    offsets, total = {}, 0
    for task, n in sorted(map(tuple, numbered.groupBy("_task").count().collect())):  # a row per task
        offsets[task], total = total, total + n
    if not total:
        return rows
    starts = rows.sparkSession.createDataFrame(list(offsets.items()), "_task bigint, _start bigint")
    chunk = F.floor((F.col("_start") + F.col("_row")) / chunk_docs).cast("int")
    chunks = -(-total // chunk_docs)
    placed = numbered.join(F.broadcast(starts), "_task").withColumn("_chunk", chunk)
    return placed.repartitionById(chunks, "_chunk").drop("_task", "_row", "_chunk", "_start")


def write_snapshot(readings: DataFrame, root: str, run_id: str) -> str:
    """All rows of one run as JSON lines, in a folder of its own: an earlier dump stays until it
    has been converted."""
    return write_chunks(readings, root, run_id, chunk_docs=0, max_files=None)


def archive_layout(raw: DataFrame) -> DataFrame:
    """Raw readings with parsed time and calendar columns; rows without time have NULL parts."""
    timed = with_archive_time(raw)
    return timed.withColumns(calendar_parts("event_ts"))


def append_archive(spark: SparkSession, raw: DataFrame, path: str) -> None:
    """Add raw readings to the columnar archive, each identity once, also over repeated runs.

    Only archived readings from the hours of ``raw`` are compared; the rest of the archive is
    not read.
    """
    rows = archive_layout(unique_readings(raw))
    if open_table(spark, path, rows.schema) is not None:
        past = read_archive(spark, path).where(touched_hours(with_archive_time(raw), "event_ts"))
        rows = without_identities(rows, past)
    # readings are looked up by identity, which is spread over all files
    append(rows, path, ARCHIVE_PARTITIONS, bloom_options("_id"))


def manifest(
    spark: SparkSession,
    files: str,
    *,
    run_id: str,
    archived_at: str,
    source: str,
    policy: str,
    cutoff: str,
    docs_deleted: int,
) -> DataFrame:
    """One row describing an archive run, counted from the files it wrote.

    Up to ``LISTED_PATHS`` files are named one by one; of more, the folder is named that holds them and nothing else.
    """
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    many = system.getContentSummary(target).getFileCount() > LISTED_PATHS
    written = (
        read_ndjson(spark, files)
        .select("event_timestamp", F.col("_metadata.file_path").alias("file"))
        .groupBy("file")
        .agg(F.count(F.lit(1)).alias("n"), F.min("event_timestamp").alias("lo"), F.max("event_timestamp").alias("hi"))
    )
    return written.agg(
        F.lit(run_id).alias("run_id"),
        F.lit(archived_at).cast("timestamp").alias("archived_at_utc"),
        F.lit(source).alias("source"),
        F.lit(policy).alias("policy"),
        F.lit(cutoff).alias("cutoff_str"),
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("docs_archived"),
        F.lit(docs_deleted).cast("bigint").alias("docs_deleted"),
        F.min("lo").alias("min_event_timestamp"),
        F.max("hi").alias("max_event_timestamp"),
        (F.array(F.lit(files)) if many else F.sort_array(F.collect_list("file"))).alias("data_paths"),
    )


def write_manifest(row: DataFrame, root: str, run_id: str) -> str:
    target = run_path(root, run_id)
    row.coalesce(1).write.mode("overwrite").json(target)
    return target
