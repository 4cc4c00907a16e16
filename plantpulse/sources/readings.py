"""Scans of raw readings: hot store, NDJSON, topic, columnar archive, and their union."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, TimestampType

from plantpulse.constants import EVENT_TIME_PATTERN, TOPIC
from plantpulse.functions.timing import (
    RAW_TIME,
    archive_hours,
    as_utc,
    parse_event_time,
    timestamp_literal,
)
from plantpulse.operators.lookup import only_identities, without_identities
from plantpulse.schemas import READING

HOT_PARTITIONS = ("event_date", "event_hour", "ingest_batch")
ARCHIVE_PARTITIONS = ("factory_id", "year", "month", "day", "hour")


def read_hot(
    spark: SparkSession,
    path: str | None = None,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """The hot store, raw. ``fmt`` and ``options`` go to the reader, so a document-store connector
    on the class path works as well as files. The partitioned file store has ``sinks.hot.open_hot``."""
    reader = spark.read.format(fmt).options(**(options or {}))
    return reader.load(path) if path else reader.load()


def read_ndjson(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One JSON object per line with the fixed schema: a bad field is NULL, a bad line all NULL."""
    return spark.read.schema(READING).option("mode", "PERMISSIVE").json(path)


def topic_options(servers: str | list[str], topic: str = TOPIC, **extra: str) -> dict[str, str]:
    """Reader options of the event topic, from its beginning. The position of a running stream is
    kept by its checkpoint, which takes the place of a consumer group."""
    brokers = servers if isinstance(servers, str) else ",".join(servers)
    return {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        **extra,
    }


def read_topic(spark: SparkSession, servers: str | list[str], topic: str = TOPIC, **extra: str) -> DataFrame:
    """The event topic as a stream of raw readings; needs the Kafka connector on the class path."""
    return decode_messages(read_topic_records(spark, servers, topic, **extra))


def read_topic_records(spark: SparkSession, servers: str | list[str], topic: str = TOPIC, **extra: str) -> DataFrame:
    """The event topic as a stream of messages with their places, for ``parse_messages`` or ``live.store_messages``."""
    return spark.readStream.format("kafka").options(**topic_options(servers, topic, **extra)).load()


#: What may be wrong with a message: it is no JSON object, or a field does not have its type (and reads as NULL).
UNPARSED, MISTYPED = "unparsed", "mistyped"
_PLACES = ("topic", "partition", "offset", "file")


def decode_messages(records: DataFrame) -> DataFrame:
    """Raw readings from UTF-8 JSON messages in ``value``.

    A message without ``_id`` is named by its place in the topic, if known, so that reading it
    again gives the same identity. Messages that are no JSON objects come as rows of NULLs; ``parse_messages`` keeps them apart.
    """
    body = F.from_json(F.col("value").cast("string"), READING).alias("body")
    place = [c for c in ("topic", "partition", "offset") if c in records.columns]
    rows = records.select(body, *place)
    if not place:
        return rows.select("body.*")
    named = F.coalesce(F.col("body._id"), F.concat_ws("-", *place)).alias("_id")
    return rows.select(named, *[F.col(f"body.{f.name}") for f in READING.fields if f.name != "_id"])


def parse_messages(records: DataFrame) -> DataFrame:
    """Messages with their reading and what is wrong with them.

    Columns: those of a raw reading, ``message`` (the text), ``fault`` (NULL, ``unparsed`` or ``mistyped``) and the place
    (topic, partition and offset, or file) as far as ``records`` has it. A NULL message is unparsed.
    """
    text = F.col("value").cast("string")
    corrupt = "_corrupt_record"
    schema = StructType([*READING.fields, StructField(corrupt, StringType())])
    place = [c for c in _PLACES if c in records.columns]
    # the keys of what is no object are NULL
    fault = F.when(F.json_object_keys("message").isNull(), UNPARSED).when(F.col(f"body.{corrupt}").isNotNull(), MISTYPED)
    rows = records.select(
        text.alias("message"), F.from_json(text, schema, {"columnNameOfCorruptRecord": corrupt}).alias("body"), *place
    )
    topic = [c for c in place if c != "file"]
    named = F.coalesce("body._id", F.concat_ws("-", *topic)) if topic else F.col("body._id")
    fields = [F.col(f"body.{f.name}") for f in READING.fields if f.name != "_id"]
    return rows.select(named.alias("_id"), *fields, "message", fault.alias("fault"), *place)


def good_readings(parsed: DataFrame) -> DataFrame:
    """Raw readings of ``parse_messages``: with the dead letters that are unparsed they make up all messages."""
    return parsed.where(F.col("fault").isNull() | (F.col("fault") != UNPARSED)).select(*READING.fieldNames())


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Messages of ``parse_messages`` that lost something: text, fault and place."""
    place = [c for c in _PLACES if c in parsed.columns]
    return parsed.where("fault IS NOT NULL").select("message", "fault", *place)


def ndjson_messages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of JSON files as messages for ``parse_messages``; blank lines are none."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select("value", F.col("_metadata.file_path").alias("file"))


def store_bytes(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Size and number of the files below ``path``, one row. Files are listed, never opened."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "length")
    )
    return files.agg(
        F.coalesce(F.sum("length"), F.lit(0).cast("bigint")).alias("bytes"),
        F.count(F.lit(1)).alias("files"),
    )


def read_archive(
    spark: SparkSession,
    path: str,
    *,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    factories: list[str] | None = None,
) -> DataFrame:
    """The columnar archive, or the part in ``[start, end)`` and of the given factories.

    Hours and factories are partition columns, so other directories are not listed or read; the
    exact bounds then cut within the first and last hour.
    """
    table = spark.read.schema(_archive_schema()).parquet(path)
    if factories is not None:
        table = table.where(F.col("factory_id").isin(factories))
    if start is not None or end is not None:
        table = table.where(archive_hours(start, end))
    if start is not None:
        table = table.where(F.col("event_ts") >= timestamp_literal(start))
    if end is not None:
        table = table.where(F.col("event_ts") < timestamp_literal(end))
    return table


#: Identities that are looked up through the Bloom filters of files; more are joined.
LISTED_IDS = 1000


def find_readings(archive: DataFrame, ids: DataFrame) -> DataFrame:
    """Readings of ``archive`` (see ``read_archive``, bounded in time or not) with an ``_id`` of ``ids``.

    Up to ``LISTED_IDS`` identities are stated as a filter that the file scan checks against Bloom filters, so that
    row groups without any of them are not read: what is read grows with the hits, not with the archive. More are joined
    by key, the smaller side broadcast if AQE finds it small.
    """
    named = ids.select("_id").where("_id IS NOT NULL").distinct()
    listed = [r["_id"] for r in named.limit(LISTED_IDS + 1).collect()]
    if len(listed) > LISTED_IDS:
        return only_identities(archive, named)
    if not listed:
        return archive.where(F.lit(False))
    # a tree of equalities: a long IN list would reach the scan as a range only
    terms = [F.col("_id") == i for i in sorted(listed)]
    while len(terms) > 1:
        terms = [terms[i] | terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return archive.where(terms[0])


def _archive_schema() -> StructType:
    parts = [StructField(part, IntegerType()) for part in ARCHIVE_PARTITIONS[1:]]
    return StructType([*READING.fields, StructField("event_ts", TimestampType()), *parts])


def history(hot: DataFrame, archive: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Hot and archived readings as one table, each identity once, in the raw schema.

    ``chunks``: JSON lines of archive runs, converted to the columnar archive or not. A reading is in two stores while
    a run is under way or its files are kept, so archived readings are looked up by identity, in those hours alone that
    the other store has readings of; the bulk of the archive is scanned without a shuffle. Hot store and archive are
    taken to hold an identity once each, as ``unique_readings`` leaves it.
    """
    columns = [f.name for f in READING.fields]
    hot = hot.select(columns)
    if chunks is not None:
        chunks = unique_readings(chunks.select(columns))
        chunks = without_identities(chunks, archive.where(touched_hours(with_archive_time(chunks), "event_ts")))
        hot = without_identities(hot, chunks)
    new = without_identities(hot, archive.where(touched_hours(with_archive_time(hot), "event_ts")))
    parts = archive.select(columns).unionByName(new)
    return parts if chunks is None else parts.unionByName(chunks)


def archived_readings(spark: SparkSession, archive: str | None = None, chunks: list[str] = ()) -> DataFrame | None:
    """Readings outside the hot store, in the raw schema: the columnar archive and JSON lines that have not been
    converted yet; None without either. A reading that is in both comes twice."""
    parts = [] if archive is None else [read_archive(spark, archive).select(*READING.fieldNames())]
    if chunks:
        parts.append(read_ndjson(spark, list(chunks)))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else None


def with_archived(raw: DataFrame, archived: DataFrame | None, period: Column) -> DataFrame:
    """``raw`` completed by those ``archived`` readings, each identity once, whose ``period`` (a minute or day, from
    the raw event time) ``raw`` has readings of."""
    if archived is None:
        return raw
    columns = READING.fieldNames()
    touched = raw.select(period.alias("_period")).where("_period IS NOT NULL").distinct()
    same = archived.select(*columns).withColumn("_period", period).join(touched, "_period", "left_semi")
    rest = without_identities(unique_readings(same.select(*columns)), raw)
    return raw.select(*columns).unionByName(rest)


def time_span(df: DataFrame, ts: str) -> tuple[datetime, datetime] | None:
    """First and last time in ``df``, to the second; None without any."""
    lo, hi = (F.date_format(f(ts), EVENT_TIME_PATTERN) for f in (F.min, F.max))
    first, last = df.agg(lo, hi).first()
    return None if first is None else (as_utc(first), as_utc(last))


def span_hours(span: tuple[datetime, datetime] | None) -> Column:
    """Archive partitions that can hold copies of readings from ``span``: its hours, and the
    partition of readings whose time does not parse. Uses partition columns only."""
    keep = F.col("year").isNull()
    return keep if span is None else keep | archive_hours(span[0], span[1] + timedelta(seconds=1))


#: Hours that are listed one by one; of more, only the first and last count.
LISTED_HOURS = 10_000


def touched_hours(df: DataFrame, ts: str) -> Column:
    """Archive partitions that can hold copies of the readings of ``df``: the hours it has readings of, and the
    partition of readings whose time does not parse. A few outliers in time add their own hours only."""
    hour = F.date_format(ts, "yyyyMMddHH").cast("bigint").alias("hour")
    found = df.select(hour).where("hour IS NOT NULL").distinct().limit(LISTED_HOURS + 1).collect()
    if len(found) > LISTED_HOURS:
        return span_hours(time_span(df, ts))
    year, month, day, of_day = (F.col(c).cast("bigint") for c in ("year", "month", "day", "hour"))
    place = ((year * 100 + month) * 100 + day) * 100 + of_day
    return F.col("year").isNull() | place.isin([r["hour"] for r in found])


def unique_readings(readings: DataFrame) -> DataFrame:
    """Each identity once; copies that differ resolve to the least row, so runs repeat.

    Copies are first reduced within each input partition, so a reading that was redelivered very
    often does not end up whole in one task. Rows without identity are no copies of each other.
    """
    rest = [c for c in readings.columns if c != "_id"]
    lone = F.when(F.col("_id").isNull(), F.monotonically_increasing_id()).alias("_lone")
    kept = (
        readings.select("_id", lone, F.struct(*rest).alias("row"))
        .groupBy("_id", "_lone")
        .agg(F.min("row").alias("row"))
    )
    return kept.select("_id", "row.*").select(*readings.columns)


def with_archive_time(raw: DataFrame) -> DataFrame:
    """Raw readings with the parsed time under the archive's column name."""
    return raw.withColumn("event_ts", parse_event_time(RAW_TIME))

