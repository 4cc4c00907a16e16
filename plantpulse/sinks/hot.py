"""The hot store as files: raw readings by day and hour of event time and by ingest batch.

Every write makes folders of its own, ``event_date=/event_hour=/write=``; which of them count is said by (see ``sinks.versions``). So a batch delivered again replaces itself, readers see a write or a delete as a whole
or not at all, and writers do not disturb each other. Deleting readings drops folders that lose all rows and
notes the identities that others lose; reads leave those out until ``compact_hot`` folds them in.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StringType, StructField, StructType

from plantpulse.functions.timing import RAW_TIME, parse_event_time
from plantpulse.operators.lookup import only_identities
from plantpulse.schemas import READING
from plantpulse.session import scratch
from plantpulse.sinks import versions
from plantpulse.sinks.tables import replace_partitions
from plantpulse.sinks.versions import Conflict, Folder, Version
from plantpulse.sources.readings import HOT_PARTITIONS, LISTED_HOURS, time_span

#: Folder level and column that tells writes apart.
WRITE = "write"
_PLACE = [StructField("event_date", DateType()), StructField("event_hour", IntegerType())]
HOT_SCHEMA = StructType(
    [
        *READING.fields,
        StructField("ingest_batch", StringType()),
        StructField("event_second", LongType()),
        *_PLACE,
        StructField(WRITE, StringType()),
    ]
)
#: Deleted readings: identity, and the write that holds them. ``write`` is that of the list itself.
GONE_SCHEMA = StructType(
    [StructField("_id", StringType()), StructField("holder", StringType()), *_PLACE, StructField(WRITE, StringType())]
)
_GONE = "_gone"
_LEVELS = ("event_date", "event_hour", WRITE)
#: How long jobs and streams leave replaced files to those who read them.
READERS_MINUTES = 60
#: Steps of either axis of the curve that compacted rows follow; a power of two.
CURVE = 256
#: Parquet bytes that one task of a compaction sorts; as rows in memory they take up to 25 times as much.
SORT_BYTES = 8 << 20


Change = tuple[list[Folder], list[Folder], list[Folder]]


def write_hot_batch(raw: DataFrame, path: str, batch: str, *, keep_minutes: float = 0) -> None:
    """Store one batch of raw readings; a batch of the same name replaces the earlier one, all or nothing.

    ``keep_minutes``: how long replaced files stay for those who read them. Should the earlier one have been compacted
    together with others, those folders are rewritten without it.
    """
    spark = raw.sparkSession
    ts = parse_event_time(RAW_TIME)
    rows = raw.select(
        *READING.fieldNames(),
        F.lit(batch).alias("ingest_batch"),
        F.unix_timestamp(ts).alias("event_second"),
        F.to_date(ts).alias("event_date"),
        F.hour(ts).alias("event_hour"),
    )
    added = _written(spark, rows, path, batch)

    def change(base: Version) -> Change:
        same = [f for f in base.rows() if batch in f.batches]
        mixed = [f for f in same if f.batches != (batch,)]
        return added + _rewritten(spark, path, base, mixed, without=batch), same, []

    _commit(spark, path, change, keep_minutes, batch)


def open_hot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Readings of the hot store, with its partition columns; of the present version, or of an earlier one that is kept."""
    found = versions.version(spark, path, version)
    if found is None:
        return spark.read.schema(HOT_SCHEMA).parquet(path).drop(WRITE)  # says that nothing is there
    return hot_rows(spark, path, found, found.rows())


def newest_second(spark: SparkSession, path: str) -> int | None:
    """Newest event time in the store as seconds since 1970; None without any.

    The version names the newest hour. In folders that have lost no readings the files' footers tell the rest: the maximum
    is pushed down to them and no column is read. Only where readings were deleted is the column scanned.
    """
    found = versions.version(spark, path)
    timed = sorted({f.place for f in (found.rows() if found else ()) if f.date is not None}, reverse=True)
    for place in timed:  # an hour whose readings are all deleted has no folder, so the first one answers
        folders = [f for f in found.rows() if f.place == place]
        losing = {w for g in found.gone() if g.place == place for w in g.batches}
        parts = []
        if whole := [f for f in folders if f.write not in losing]:
            parts.append(_footers(spark, path, whole))
        if rest := [f for f in folders if f.write in losing]:
            parts.append(_rows(spark, path, found, rest).agg(F.max("event_second").alias("newest")))
        known = [n for (n,) in (p.first() for p in parts) if n is not None]
        if known:
            return max(known)
    return None


def _footers(spark: SparkSession, path: str, folders: list[Folder]) -> DataFrame:
    """Newest second of folders, by a session of its own in which Parquet is a source that aggregates can be pushed to."""
    session = spark.newSession()
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    paths = [f"{path.rstrip('/')}/{f.path}" for f in folders]
    stored = StructType([f for f in HOT_SCHEMA if f.name not in _LEVELS])  # as in the files: footers are read by position
    return session.read.schema(stored).parquet(*paths).agg(F.max("event_second").alias("newest"))


def hot_version(spark: SparkSession, path: str) -> int | None:
    """Number of the present version."""
    found = versions.numbers(spark, path)
    return found[-1] if found else None


def hot_rows(spark: SparkSession, path: str, base: Version, folders: list[Folder]) -> DataFrame:
    """Readings of some of the folders of a version, with partition columns."""
    return _rows(spark, path, base, folders).drop("event_second", WRITE)


def hot_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files that count, from the version alone: nothing is listed or opened."""
    found = versions.version(spark, path)
    return sum(f.bytes for f in found.folders) if found else 0


class ReconcileError(RuntimeError):
    """Written, archived and deleted counts of a run differ."""


def delete_hot(
    spark: SparkSession, path: str, archived: DataFrame, expected: int | None = None, *, keep_minutes: float = 0
) -> int:
    """Delete the readings whose identity is in ``archived`` (raw schema, safely stored), all or nothing.

    Returns how many rows were deleted; if that would not be ``expected``, nothing is deleted and
    ReconcileError raised. Only hours with archived readings are read, and of them only identities. No reading is
    rewritten: folders that lose all their rows are dropped, for others the lost identities are written.
    """
    with scratch(spark, "hot-delete") as staged:
        times = archived.select("_id", parse_event_time(RAW_TIME).alias("ts"))
        times.write.parquet(f"{staged}/ids")
        ids = spark.read.schema(times.schema).parquet(f"{staged}/ids")
        hours = _hours_of(ids)
        ids = ids.where("_id IS NOT NULL").select("_id").distinct()
        deleted = 0

        def change(base: Version) -> Change:
            nonlocal deleted
            stored = _rows(spark, path, base, base.rows()).where(hours).select("_id", "event_date", "event_hour", WRITE)
            hits = stored.join(ids.withColumn("hit", F.lit(1)), "_id", "left")
            counts = hits.groupBy("event_date", "event_hour", WRITE).agg(
                F.count("hit").alias("lost"), F.count(F.lit(1)).alias("held")
            )
            losing = {}
            for r in counts.where("lost > 0").collect():  # a row per folder
                day = None if r["event_date"] is None else str(r["event_date"])
                losing[r[WRITE], day, r["event_hour"]] = r
            deleted = sum(r["lost"] for r in losing.values())
            if expected is not None and deleted != expected:
                raise ReconcileError(f"expected={expected} found={deleted}; nothing deleted")
            touched = [(f, losing[f.write, *f.place]) for f in base.rows() if (f.write, *f.place) in losing]
            emptied = [f for f, r in touched if r["lost"] == r["held"]]
            partly = [f for f, r in touched if r["lost"] < r["held"]]
            return _noted(spark, path, base, partly, ids), emptied, partly

        _commit(spark, path, change, keep_minutes)
        return deleted


def compact_hot(
    spark: SparkSession,
    path: str,
    *,
    before: datetime | None = None,
    most_files: int = 4,
    file_bytes: int = 128 << 20,
    keep_minutes: float = 0,
) -> int:
    """Rewrite hours that have more than ``most_files`` files, or lists of deleted readings, into few files of about
    ``file_bytes``, or of ``SORT_BYTES`` if that is less, as a task sorts what goes into a file; returns how many.

    ``before``: only hours that ended by then, to leave hours alone that are still filling. Rows follow a curve through
    machine and time (bits of both in turn), so that files and row groups can be skipped for either. Readers
    and writers go on meanwhile: a batch that arrives is not touched, and if one of the hours changes the work is
    done again.
    """
    done = 0
    file_bytes = min(file_bytes, SORT_BYTES)

    def change(base: Version) -> Change:
        nonlocal done
        places: dict[tuple, list[Folder]] = {}
        for f in base.folders:
            places.setdefault(f.place, []).append(f)
        picked = []
        for (day, hour), folders in places.items():
            over = before is None or day is None or datetime.fromisoformat(f"{day}T{hour:02d}:59:59") < before
            rows = [f for f in folders if f.kind == "rows"]
            # a large hour that was cut has a file or two more than its size calls for
            many = sum(f.files for f in rows) > max(most_files, 2 * sum(f.bytes for f in rows) // file_bytes + 1)
            if over and (many or any(f.kind == "gone" for f in folders)):
                picked += folders
        done = len({f.place for f in picked})
        rows = [f for f in picked if f.kind == "rows"]
        return _rewritten(spark, path, base, rows, file_bytes=file_bytes), picked, []

    _commit(spark, path, change, keep_minutes)
    return done


def sweep_hot(spark: SparkSession, path: str, hours: float = 24) -> int:
    """Delete folders that writers left which died before they published; younger ones than ``hours`` stay."""
    return sum(versions.sweep(spark, path, f"{root}event_date=*/event_hour=*/{WRITE}=*", hours) for root in ("", f"{_GONE}/"))


def _commit(
    spark: SparkSession,
    path: str,
    change: Callable[[Version], Change],
    keep_minutes: float,
    batch: str | None = None,
) -> None:
    """Publish what ``change`` makes of the present version: (folders to add, to drop, that must not be replaced)."""
    for _ in range(versions.TRIES):
        base = versions.version(spark, path) or Version(-1, ())
        add, drop, needs = change(base)
        try:
            if add or drop or base.number < 0:
                versions.commit(spark, path, base, add, drop, needs, batch)
        except Conflict:
            continue
        versions.expire(spark, path, keep_minutes)
        return
    raise Conflict(f"overtaken {versions.TRIES} times")


def _read(spark: SparkSession, root: str, schema: StructType, folders: list[Folder], prefix: str = "") -> DataFrame:
    paths = [f"{root.rstrip('/')}/{f.path}" for f in folders]
    found = spark.read.schema(schema).option("basePath", f"{root.rstrip('/')}/{prefix}").parquet(*paths)
    return found.select(*schema.fieldNames())


def _rows(spark: SparkSession, path: str, base: Version, folders: list[Folder]) -> DataFrame:
    """Readings in ``folders``, without deleted ones; only folders that have lost some are joined with the lists."""
    columns = [*READING.fieldNames(), *HOT_PARTITIONS, "event_second", WRITE]
    if not folders:
        return spark.createDataFrame([], HOT_SCHEMA).select(*columns)
    lists = [g for g in base.gone() if any(f.place == g.place and f.write in g.batches for f in folders)]
    holders = {(g.place, w) for g in lists for w in g.batches}
    whole = [f for f in folders if (f.place, f.write) not in holders]
    losing = [f for f in folders if (f.place, f.write) in holders]
    parts = [_read(spark, path, HOT_SCHEMA, whole)] if whole else []
    if losing:
        rows, gone = _read(spark, path, HOT_SCHEMA, losing), _read(spark, path, GONE_SCHEMA, lists, f"{_GONE}/")
        same = (rows["_id"] == gone["_id"]) & (rows[WRITE] == gone["holder"])
        for c in ("event_date", "event_hour"):
            same = same & rows[c].eqNullSafe(gone[c])
        parts.append(rows.join(gone, same, "left_anti"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.select(*columns)


def _folders(spark: SparkSession, path: str, kind: str, prefix: str, write: str) -> list[Folder]:
    """What a write has made; what it was made from is left to the caller."""
    found = []
    for made in versions.written(spark, path, f"{prefix}event_date=*/event_hour=*/{WRITE}={write}"):
        day, hour = re.search(r"event_date=([^/]*)/event_hour=([^/]*)/", made).groups()
        place = (day, int(hour)) if hour.isdigit() else (None, None)
        size, files = versions.measured(spark, path, made)
        found.append(Folder(kind, made, *place, (), (), write, size, files))
    return found


def _written(spark: SparkSession, rows: DataFrame, path: str, batch: str) -> list[Folder]:
    write = versions.new_write()
    replace_partitions(rows.withColumn(WRITE, F.lit(write)), path, _LEVELS)
    return [replace(f, batches=(batch,), sources=((write, batch),)) for f in _folders(spark, path, "rows", "", write)]


def _noted(spark: SparkSession, path: str, base: Version, folders: list[Folder], ids: DataFrame) -> list[Folder]:
    """Lists of those identities in ``folders`` that are among ``ids``."""
    if not folders:
        return []
    lost = only_identities(_rows(spark, path, base, folders).select("_id", "event_date", "event_hour", WRITE), ids)
    write = versions.new_write()
    rows = lost.select("_id", F.col(WRITE).alias("holder"), "event_date", "event_hour", F.lit(write).alias(WRITE))
    replace_partitions(rows, f"{path.rstrip('/')}/{_GONE}", _LEVELS)
    made = _folders(spark, path, "gone", f"{_GONE}/", write)
    return [replace(g, batches=tuple(sorted(f.write for f in folders if f.place == g.place))) for g in made]


def _rewritten(
    spark: SparkSession, path: str, base: Version, folders: list[Folder], *, without: str | None = None, file_bytes: int = SORT_BYTES
) -> list[Folder]:
    """The rows of ``folders`` (but those of batch ``without``) anew, in order of the curve.

    Hours below ``file_bytes`` become one file each; larger ones are cut along the curve, at places Spark samples.
    """
    sizes: dict[tuple, int] = {}
    for f in folders:
        sizes[f.place] = sizes.get(f.place, 0) + f.bytes
    made = []
    for large in (False, True):
        part = [f for f in folders if (sizes[f.place] > file_bytes) == large]
        if not part:
            continue
        rows = _rows(spark, path, base, part).drop(WRITE)
        if without is not None:
            rows = rows.where(F.col("ingest_batch") != without)
        write = versions.new_write()
        placed = _on_curve(rows.withColumn(WRITE, F.lit(write)))
        places = {f.place for f in part}
        if large:
            cuts = sum(math.ceil(sizes[p] / file_bytes) for p in places)
            placed = placed.repartitionByRange(cuts, "event_date", "event_hour", "_curve")
        else:
            placed = placed.repartition(len(places), "event_date", "event_hour")
        ordered = placed.sortWithinPartitions(*_LEVELS, "_curve").select(*HOT_SCHEMA.fieldNames())
        writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*_LEVELS).parquet(path)
        for f in _folders(spark, path, "rows", "", write):
            sources = sorted({s for old in part if old.place == f.place for s in old.sources if s[1] != without})
            made.append(replace(f, batches=tuple(sorted({b for _, b in sources})), sources=tuple(sources)))
    return made


def _on_curve(rows: DataFrame) -> DataFrame:
    """Adds ``_curve``: bits of machine and of time within the hour in turn, so that near places are near in both.

    Machines are numbered by ranges of their names, dealt by Spark's range partitioning over distinct names; a
    machine with a third of all readings takes one number, time still splits it.
    """
    names = rows.select("machine_id").distinct().repartitionByRange(CURVE, "machine_id")
    names = names.select(F.col("machine_id").alias("_name"), F.spark_partition_id().alias("_x"))
    (last,) = names.agg(F.max("_x")).first()  # few machines take few numbers: spread them over the axis
    names = names.withColumn("_x", F.floor(F.col("_x") * CURVE / ((last or 0) + 1)).cast("int"))
    ts = parse_event_time(RAW_TIME)
    second = F.coalesce(F.minute(ts) * 60 + F.second(ts), F.lit(0))
    y = F.floor(second * CURVE / 3600).cast("int")
    joined = rows.join(names, rows["machine_id"].eqNullSafe(names["_name"])).withColumn("_y", y)
    place = F.lit(0)
    for bit in range(CURVE.bit_length() - 1):
        for axis, shift in (("_y", 2 * bit), ("_x", 2 * bit + 1)):
            place = place + F.shiftleft(F.shiftright(axis, bit).bitwiseAND(F.lit(1)), shift)
    return joined.withColumn("_curve", place).drop("_name", "_x", "_y")


def hot_hours(first: datetime | None = None, last: datetime | None = None) -> Column:
    """Partitions that can hold readings from ``first`` to ``last``, and that of unparsed times."""
    keep = F.lit(True)
    if first is not None:
        day = F.lit(first.date())
        keep = keep & ((F.col("event_date") > day) | ((F.col("event_date") == day) & (F.col("event_hour") >= first.hour)))
    if last is not None:
        day = F.lit(last.date())
        keep = keep & ((F.col("event_date") < day) | ((F.col("event_date") == day) & (F.col("event_hour") <= last.hour)))
    return F.col("event_date").isNull() | keep


def _hours_of(ids: DataFrame) -> Column:
    """Partitions of the hours in ``ids`` (_id, ts), listed one by one up to ``LISTED_HOURS``, and that of unparsed times."""
    hour = F.date_format("ts", "yyyyMMddHH").cast("bigint").alias("hour")
    found = ids.select(hour).where("hour IS NOT NULL").distinct().limit(LISTED_HOURS + 1).collect()
    if len(found) > LISTED_HOURS:
        return hot_hours(*time_span(ids, "ts"))
    day = F.year("event_date") * 10_000 + F.month("event_date") * 100 + F.dayofmonth("event_date")
    place = day.cast("bigint") * 100 + F.col("event_hour")
    return F.col("event_date").isNull() | place.isin([r["hour"] for r in found])
