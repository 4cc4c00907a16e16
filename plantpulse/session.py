"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app: str = "plantpulse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; sizes are left to the cluster.

    AQE stays on: it coalesces small shuffle partitions, splits skewed ones (also those of the
    rebalancing writers) and turns joins into broadcasts from measured sizes.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # recording the call site of every column costs more than building the short plans here
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Event texts carry no zone and mean UTC, so they must be parsed in a UTC session."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall back to a temporary
    folder; it becomes the session's checkpoint folder, so that all callers agree on it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plantpulse-"))
    return spark.sparkContext.getCheckpointDir()


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused between runs."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there, in whatever file system holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """A work path that is deleted at the end, also after a failure."""
    path = work_path(spark, label)
    try:
        yield path
    finally:
        remove_path(spark, path)
