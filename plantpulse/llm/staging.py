"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.session import remove_path, work_path

_recorded: list[str] = []
_recording = False
_PATH = "_staged_path"


def stage_of_pipeline(stage: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """For a stage whose result is written before the next one starts: the tables it stages go when the next one does.

    A table that the next stage's documents still read, because its predecessor was not written, stays.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _recording
        _release(spark, docs)
        _recording = True
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _recording = False

    return run


def _release(spark: SparkSession, docs: DataFrame) -> None:
    """Delete recorded tables that ``docs`` does not read, and let Spark drop the shuffles of what is no longer held."""
    if not _recorded:
        return
    read = [f.split("://", 1)[-1].removeprefix("file:") for f in docs.inputFiles()]
    for path in list(_recorded):
        bare = path.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
        if not any(bare.lstrip("/") in f for f in read):
            remove_path(spark, path)
            _recorded.remove(path)
    drop_shuffles(spark)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet below ``spark.checkpoint.dir`` and read back.

    Cuts the lineage: whatever is computed from the result survives lost executors, and several
    readers do not compute ``df`` again. The folder expires the files, but for those of pipeline stages.
    """
    path = work_path(df.sparkSession, label)
    if _recording:
        _recorded.append(path)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    setattr(table, _PATH, path)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``staged`` has returned and no result reads any more. Other DataFrames
    are left alone."""
    for table in tables:
        if path := getattr(table, _PATH, None):
            remove_path(table.sparkSession, path)
            if path in _recorded:
                _recorded.remove(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of DataFrames that are no longer held."""
    spark.sparkContext._jvm.System.gc()


#: Rows of ids that may be broadcast; one row takes 100 bytes or so.
BROADCAST_ROWS = 200_000


def staged_ids(df: DataFrame, label: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, rows of a few ids, staged and marked for broadcast if they are counted to be few enough.

    Joined with texts, many ids cost a shuffle of the texts, few do not.
    """
    ids = staged(df, label)
    if ids.count() > most:
        return ids
    hinted = F.broadcast(ids)
    setattr(hinted, _PATH, getattr(ids, _PATH))
    return hinted


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
