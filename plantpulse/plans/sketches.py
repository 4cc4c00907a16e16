"""Heavy hitters and distinct counts of machine codes from sketches per hour and batch, which add up over any range.

Sketches are made once, when a batch has come, and have a bounded size whatever the number of codes. A ranking from them is
checked: candidates are counted exactly, and if a code that the sketch may have missed could still rank, all codes are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.functions.codes import clean_code
from plantpulse.operators.lookup import attach
from plantpulse.operators.quality import unmatched_machines
from plantpulse.sinks import versions
from plantpulse.sinks.hot import hot_rows
from plantpulse.sinks.tables import in_same_partitions, open_table, swap_partitions, upsert

#: Codes that a sketch tracks. With n readings it misses none that has more than about n * 3.5 * 3 / 4 / TRACKED.
TRACKED = 3000
_TOP = "struct<sketch: binary, maxItemsTracked: int, itemDataType: string, itemDataTypeDDL: string>"
SKETCHES = (
    f"source_write string, source_batch string, readings bigint, codeless bigint, codes binary, top {_TOP}, "
    "event_date date, event_hour int"
)
_PLACE = ("event_date", "event_hour")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    return open_table(spark, path, spark.createDataFrame([], SKETCHES).schema)


def refresh_sketches(spark: SparkSession, hot: str, path: str, tracked: int = TRACKED) -> int:
    """Sketch the batches of the hot store that the table at ``path`` does not have; returns how many parts of batches.

    Readings that have left the store stay in their sketches. A batch delivered again replaces its own. Readings without
    time belong to no hour and are left out. Compacted hours are asked for their new batches alone.
    """
    base = versions.version(spark, hot)
    folders = [f for f in (base.rows() if base else ()) if f.date is not None]
    known: set[tuple] = set()
    if (table := _table(spark, path)) is not None:  # a row per hour and batch
        rows = table.select("source_write", "source_batch", F.col("event_date").cast("string"), "event_hour").collect()
        known = set(map(tuple, rows))
    new = {(w, b, *f.place) for f in folders for w, b in f.sources} - known
    if not new:
        return 0
    wanted = [f for f in folders if any((w, b, *f.place) in new for w, b in f.sources)]
    listed = spark.createDataFrame(sorted(new), "source_write string, source_batch string, event_date string, event_hour int")
    listed = listed.withColumn("event_date", F.col("event_date").cast("date"))
    rows = hot_rows(spark, hot, base, wanted).withColumnRenamed("ingest_batch", "source_batch")
    rows = rows.join(F.broadcast(listed), ["source_batch", *_PLACE]).withColumn("code", clean_code(F.col("machine_id")))
    made = rows.groupBy("source_write", "source_batch", *_PLACE).agg(
        F.count(F.lit(1)).alias("readings"),
        F.count_if(F.col("code").isNull()).alias("codeless"),
        F.hll_sketch_agg("code").alias("codes"),
        F.expr(f"approx_top_k_accumulate(code, {int(tracked)})").alias("top"),
    )
    names = ["source_write", "source_batch", "readings", "codeless", "codes", "top", *_PLACE]
    upsert(spark, made.select(*names), path, ("source_batch", *_PLACE), _PLACE)
    # hours that a batch had readings of before it was delivered again without them
    renewed, present = {b: w for w, b, *_ in new}, {(b, *place) for _, b, *place in new}
    stale = {(b, *place) for w, b, *place in known if renewed.get(b, w) != w and (b, *place) not in present}
    if stale:
        gone = spark.createDataFrame(sorted(stale), "source_batch string, event_date string, event_hour int")
        gone = gone.withColumn("event_date", F.col("event_date").cast("date"))
        rows = in_same_partitions(_table(spark, path), gone, _PLACE)
        left = rows.join(F.broadcast(gone), ["source_batch", *_PLACE], "left_anti").select(*names)
        swap_partitions(left, path, _PLACE, {tuple(place) for _, *place in stale})
    return len(new)


def distinct_codes(spark: SparkSession, path: str) -> DataFrame:
    """About how many machine codes there were per day, from the sketches of its hours."""
    found = _table(spark, path).groupBy("event_date").agg(F.hll_union_agg("codes").alias("codes"), F.sum("readings").alias("readings"))
    return found.select("event_date", "readings", F.hll_sketch_estimate("codes").alias("codes"))


def top_unmatched(
    spark: SparkSession, path: str, readings: DataFrame, machines: DataFrame, top: int = 20, tracked: int = TRACKED
) -> DataFrame:
    """``quality.unmatched_machines`` of conformed ``readings``, all of which the sketches at ``path`` have seen.

    Only candidates are counted in the readings, after a broadcast join: no code of the long tail is shuffled. If the tail could
    rank, as without skew, all codes are counted. The sketches may hold more than ``readings``, such as archived ones.
    """
    table = _table(spark, path)
    known = machines.where(F.col("factory_id").isNotNull()).select("machine_id")
    if table is None:
        return unmatched_machines(readings, machines, top)
    merged = table.agg(F.expr(f"approx_top_k_combine(top, {int(tracked)})").alias("top"), F.sum("readings").alias("n"))
    best = merged.select(F.expr(f"explode(approx_top_k_estimate(top, {int(tracked)}))").alias("c")).select(
        F.col("c.item").alias("machine_id")
    )
    candidates = attach(best, known, "machine_id", how="left_anti")
    rows = readings.select("machine_id")
    named = rows.join(F.broadcast(candidates), "machine_id", "left_semi").unionAll(rows.where("machine_id IS NULL"))
    counted = named.groupBy("machine_id").agg(F.count(F.lit(1)).alias("num_events"))
    ranked = counted.orderBy(F.desc("num_events"), F.asc_nulls_first("machine_id")).limit(top).collect()  # ``top`` rows
    (total,) = merged.select("n").first()
    missed = (total or 0) * 3.5 / _slots(tracked)
    if len(ranked) < top or ranked[-1]["num_events"] <= missed:
        return unmatched_machines(readings, machines, top)
    return spark.createDataFrame([tuple(r) for r in ranked], counted.schema)


def _slots(tracked: int) -> int:
    """Size of the table behind a sketch: the power of two of which three quarters hold ``tracked`` items."""
    return 1 << max(3, (tracked * 4 // 3 - 1).bit_length())
