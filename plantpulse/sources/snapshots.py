"""Dimension tables that change while streams run: whole snapshots, of which readers take the newest complete one."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from plantpulse.schemas import DIMENSIONS

#: Dimensions of a job: tables, or a function that says what they are now.
Dimensions = Mapping[str, DataFrame] | Callable[[], Mapping[str, DataFrame]]


def current(dims: Dimensions) -> Mapping[str, DataFrame]:
    return dims() if callable(dims) else dims


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def snapshots(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of the complete snapshots of a dimension, oldest first. Spark marks a folder once all of it is written."""
    marks, files = _files(spark, f"{root.rstrip('/')}/{name}/snapshot=*/_SUCCESS")
    found = [s.getPath().getParent().getName() for s in files.globStatus(marks) or ()]
    return sorted(int(f.split("=")[1]) for f in found)


def publish_dimension(table: DataFrame, root: str, name: str, keep: int = 3) -> int:
    """Write a dimension as its next snapshot, keep the newest ``keep`` and return its number. One publisher at a time."""
    spark = table.sparkSession
    known = snapshots(spark, root, name)
    number = known[-1] + 1 if known else 0
    columns = DIMENSIONS[name].fieldNames()
    table.select(*columns).write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}/snapshot={number}")
    for old in known[: max(0, len(known) + 1 - keep)]:
        target, files = _files(spark, f"{root.rstrip('/')}/{name}/snapshot={old}")
        files.delete(target, True)
    return number


def open_dimension(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest complete snapshot of a dimension."""
    known = snapshots(spark, root, name)
    if not known:
        raise FileNotFoundError(f"no snapshot of {name} in {root}")
    return spark.read.schema(DIMENSIONS[name]).parquet(f"{root.rstrip('/')}/{name}/snapshot={known[-1]}")


def dimension_source(spark: SparkSession, root: str, *names: str) -> Callable[[], dict[str, DataFrame]]:
    """A function for jobs and streams that gives the newest snapshots each time it is asked; all published ones without names."""

    def now() -> dict[str, DataFrame]:
        wanted = names or [n for n in DIMENSIONS if snapshots(spark, root, n)]
        return {n: open_dimension(spark, root, n) for n in wanted}

    return now
