"""Partitioned Parquet tables that can be written again without doubling rows.

Partitions are replaced in three steps: the new ones are written whole beside the table, a note says that they are complete, then
each takes the place of the old one. Whoever opens or writes the table next finishes what a dead writer has noted; what was
not noted never counts.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from plantpulse.operators.lookup import BROADCAST_BYTES
from plantpulse.session import scratch


#: Where partitions wait that are to replace others; readers of the table skip the name.
PENDING = "_pending"
#: Partition values that are listed one by one when a table is pruned; of more, only the first and last count.
LISTED_VALUES = 1000
#: Tasks among which the rows of one table partition are dealt, unless they are few.
SPREAD = 4

_locks: dict[str, threading.RLock] = {}
_guard = threading.Lock()


@contextmanager
def _alone(path: str) -> Iterator[None]:
    """One writer of a table at a time in this driver."""
    with _guard:
        lock = _locks.setdefault(path.rstrip("/"), threading.RLock())
    with lock:
        yield


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def swap_partitions(
    df: DataFrame, path: str, partitions: Sequence[str], also: Iterable[Sequence[str | int]] = ()
) -> None:
    """Replace the partitions that ``df`` has rows for, so that a failure at any point loses nothing.

    ``also``: values of partitions that are emptied if ``df`` has no rows for them.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    root = f"{path.rstrip('/')}/{PENDING}"
    with _alone(path):
        recover(spark, path)
        clustered(df, partitions).write.partitionBy(*partitions).parquet(f"{root}/{name}")
        made, files = _files(spark, f"{root}/{name}/" + "/".join("*=*" for _ in partitions))
        start = files.makeQualified(_files(spark, f"{root}/{name}")[0]).toString() + "/"
        leaves = [s.getPath().toString().removeprefix(start) for s in files.globStatus(made) or ()]
        emptied = {"/".join(f"{p}={v}" for p, v in zip(partitions, values)) for values in also} - set(leaves)
        _note(spark, f"{root}/{name}.json", {"replaced": leaves, "emptied": sorted(emptied)})
        recover(spark, path)


def _note(spark: SparkSession, path: str, leaves: dict[str, list[str]]) -> None:
    """A file that is there whole or not at all."""
    draft, files = _files(spark, f"{path}.draft")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(leaves).encode()))
    out.close()
    files.rename(draft, _files(spark, path)[0])


def recover(spark: SparkSession, path: str) -> int:
    """Finish what writers have noted as complete; returns how many notes there were."""
    root = f"{path.rstrip('/')}/{PENDING}"
    pending, files = _files(spark, root)
    if not files.exists(pending):
        return 0
    with _alone(path):
        notes = [n for n in (s.getPath().getName() for s in files.listStatus(pending)) if n.endswith(".json")]
        for note in notes:
            name, (target, _) = note.removesuffix(".json"), _files(spark, f"{root}/{note}")
            stream = files.open(target)
            leaves = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            for leaf in leaves["emptied"]:
                files.delete(_files(spark, f"{path.rstrip('/')}/{leaf}")[0], True)
            for leaf in leaves["replaced"]:
                _take_place(files, _files(spark, f"{root}/{name}/{leaf}")[0], _files(spark, f"{path.rstrip('/')}/{leaf}")[0])
            files.delete(target, False)  # before its folder: without a note the folder counts for nothing
            files.delete(_files(spark, f"{root}/{name}")[0], True)
        if not len(files.listStatus(pending)):
            files.delete(pending, False)
    return len(notes)


def _take_place(files, new, old) -> None:
    """Move a folder where another is; done already if ``new`` is gone."""
    if files.exists(new):
        files.delete(old, True)
        files.mkdirs(old.getParent())
        files.rename(new, old)


def open_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The Parquet table at ``path``, after a broken-off replacement has been finished; None before its first write."""
    recover(spark, path)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def clustered(df: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """``df`` arranged so that each table partition is written by few tasks.

    The rows of a partition are dealt into ``SPREAD`` parts, so that few large partitions are not left to as few tasks.
    Rebalancing splits a part that holds a large share of the rows over several tasks and joins small ones, both from
    sizes measured at run time.
    """
    # sums of doubles may differ when a task is repeated, and its rows must go where they went before
    exact = [f.name for f in df.schema if f.dataType not in (DoubleType(), FloatType())]
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in exact]), F.lit(SPREAD))
    return df.withColumn("_part", part).hint("rebalance", *partitions, "_part").drop("_part")


def append(df: DataFrame, path: str, partitions: Sequence[str] = (), options: Mapping[str, str] | None = None) -> None:
    rows = clustered(df, partitions) if partitions else df
    rows.write.mode("append").options(**(options or {})).partitionBy(*partitions).parquet(path)


def bloom_options(column: str, values: int = 1_000_000) -> dict[str, str]:
    """Writer options for a Bloom filter on ``column`` in every row group, sized for ``values`` different ones at most."""
    return {
        f"parquet.bloom.filter.enabled#{column}": "true",
        f"parquet.bloom.filter.expected.ndv#{column}": str(values),
        "parquet.bloom.filter.adaptive.enabled": "true",
    }


def replace_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Replace the partitions that ``df`` has rows for and leave the others alone."""
    (
        clustered(df, partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def upsert(spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str], partitions: Sequence[str]) -> None:
    """Insert the rows of ``df``, replacing rows with equal ``keys`` (NULLs count as equal).

    If several rows of ``df`` have one key, they replace together what the table has under it: with a
    minute as key, whole minutes are replaced. ``partitions`` must follow from the keys. Threads of one driver take
    turns; two drivers at once would each put back what they have read. Only partitions that
    receive rows are read and rewritten. ``df`` is first written below the shared folder, so it is computed once; what
    goes into the partitions is written beside the table and swapped in whole.
    """
    with _alone(path):
        _upsert(spark, df, path, keys, partitions)


def _upsert(spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str], partitions: Sequence[str]) -> None:
    old = open_table(spark, path, df.schema)
    if old is None:
        swap_partitions(df, path, partitions)
        return
    with scratch(spark, "upsert") as staged:
        df.write.parquet(f"{staged}/new")
        new = spark.read.schema(df.schema).parquet(f"{staged}/new")
        affected = in_same_partitions(old, new, partitions)
        replaced = new.select(*keys).distinct()
        kept = affected.join(replaced, same_keys(affected, replaced, keys), "left_anti")
        swap_partitions(kept.select(df.columns).unionByName(new), path, partitions)


def in_same_partitions(old: DataFrame, new: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """Rows of ``old`` in partitions that ``new`` has rows for.

    The values of the partition columns, or their ranges if there are very many, prune the directories of ``old``; the
    join with the list of partitions then is exact, NULL partitions included.
    """
    touched = new.select(*partitions).distinct()
    listed = touched.limit(LISTED_VALUES + 1).collect()  # a row per partition
    if len(listed) <= LISTED_VALUES:
        for p in partitions:
            known = {r[p] for r in listed} - {None}
            old = old.where(F.col(p).isin(*known) | F.col(p).isNull() if known else F.col(p).isNull())
        if not listed:
            return old.where(F.lit(False))
        spark = new.sparkSession
        few = spark.createDataFrame([tuple(r) for r in listed], touched.schema)
        return old.join(F.broadcast(few), same_keys(old, few, partitions), "left_semi")
    ends = [f(p).alias(f"{p} {f.__name__}") for p in partitions for f in (F.min, F.max)]
    found = touched.agg(*ends, F.sum(F.octet_length(F.to_json(F.struct(*partitions)))).alias("bytes")).first()
    for p in partitions:
        low, high = found[f"{p} min"], found[f"{p} max"]
        known = F.lit(False) if low is None else F.col(p).between(F.lit(low), F.lit(high))
        old = old.where(known | F.col(p).isNull())
    if (found["bytes"] or 0) <= BROADCAST_BYTES:
        touched = F.broadcast(touched)
    return old.join(touched, same_keys(old, touched, partitions), "left_semi")


def new_rows(spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str], partitions: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose ``keys`` the table at ``path`` does not have yet; only the partitions
    that ``df`` has rows for are read."""
    old = open_table(spark, path, df.schema)
    if old is None:
        return df
    old = in_same_partitions(old, df, partitions)
    return df.join(old, same_keys(df, old, keys), "left_anti")
