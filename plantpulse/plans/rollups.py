"""Hour and day sums of the KPI table, and dashboard queries that read the coarsest of them that will do.

For every hour of the KPI table there are sums by all KPI keys and by machine and sensor alone; for every day the same. A
note holds which files of the KPI table each hour was summed up from: hours that have changed since are summed up anew by
the next refresh, and until then read from the KPI table itself. So a query is right whenever the refresh ran.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.constants import KPI_KEYS
from plantpulse.functions.timing import as_utc
from plantpulse.operators.lookup import BROADCAST_BYTES
from plantpulse.operators.star import aggregate, between, combined, key_of, measures, summarise, tells
from plantpulse.sinks.tables import recover, swap_partitions

Hour = tuple[str, int]
#: Keys of the sums, fewest first.
KEY_SETS = {"machine": ("factory_id", "machine_id", "sensor_type_id"), "full": KPI_KEYS}
_HOUR, _DAY = ("kpi_date", "kpi_hour"), ("kpi_date",)


def _table(out: str, grain: str, keys: str) -> str:
    return f"{out.rstrip('/')}/kpi_{grain}_{keys}"


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _signatures(spark: SparkSession, out: str) -> dict[Hour, str]:
    """Digest of the names of the files that each hour of the KPI table is made of; names are never used twice."""
    recover(spark, f"{out}/minute_kpi")
    pattern, files = _files(spark, f"{out.rstrip('/')}/minute_kpi/kpi_date=*/kpi_hour=*/*.parquet")
    names: dict[Hour, list[str]] = {}
    for s in files.globStatus(pattern) or ():
        day, hour, name = re.search(r"kpi_date=([^/]*)/kpi_hour=(\d+)/([^/]*)$", s.getPath().toString()).groups()
        names.setdefault((day, int(hour)), []).append(name)
    return {h: hashlib.md5("\n".join(sorted(n)).encode()).hexdigest() for h, n in names.items()}


def _noted(spark: SparkSession, out: str) -> dict[Hour, str]:
    target, files = _files(spark, f"{out.rstrip('/')}/kpi_rollups.json")
    if not files.exists(target):
        return {}
    stream = files.open(target)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {(day, hour): signature for day, hour, signature in json.loads(text)}


def _note(spark: SparkSession, out: str, signatures: dict[Hour, str]) -> None:
    target, files = _files(spark, f"{out.rstrip('/')}/kpi_rollups.json")
    stream = files.create(target, True)
    stream.write(bytearray(json.dumps([[*h, s] for h, s in sorted(signatures.items())]).encode()))
    stream.close()


def _in_hours(hours: Sequence[Hour]) -> Column:
    by_day: dict[str, list[int]] = {}
    for day, hour in hours:
        by_day.setdefault(day, []).append(hour)
    keep = F.lit(False)
    for day, of_day in by_day.items():
        keep = keep | ((F.col("kpi_date") == F.lit(day).cast("date")) & F.col("kpi_hour").isin(sorted(of_day)))
    return keep


def refresh_rollups(spark: SparkSession, out: str) -> int:
    """Sum up the hours of the KPI table below ``out`` that have changed, and their days; returns how many hours.

    Days are summed up from hours, the machine tables from the full ones: the KPI table is read once, in changed hours
    alone. A run that dies is repeated by the next; while it runs, queries read changed hours from the KPI table. One run
    at a time. An hour that leaves the KPI table leaves the queries with it.
    """
    now, noted = _signatures(spark, out), _noted(spark, out)
    changed = [h for h, s in now.items() if noted.get(h) != s]
    if not changed and set(noted) <= set(now):
        return 0
    _note(spark, out, {h: s for h, s in noted.items() if now.get(h) == s})  # what is about to change is not trusted
    for keys, columns in reversed(KEY_SETS.items()):
        if keys == "full":
            rows = spark.read.parquet(f"{out}/minute_kpi").where(_in_hours(changed))
            facts = measures()
        else:
            rows = spark.read.parquet(_table(out, "hour", "full")).where(_in_hours(changed))
            facts = combined()
        swap_partitions(aggregate(rows, [*columns, *_HOUR], facts), _table(out, "hour", keys), _HOUR)
        hours = spark.read.parquet(_table(out, "hour", keys))
        touched = sorted({day for day, _ in changed} | {day for day, _ in set(noted) - set(now)})
        present = [h for h in now if h[0] in touched]
        days = hours.where(_in_hours(present))
        swap_partitions(aggregate(days, [*columns, *_DAY], combined()), _table(out, "day", keys), _DAY)
    _note(spark, out, now)
    return len(changed)


@dataclass(frozen=True)
class Route:
    """Which table answers for which time: ``days`` and ``hours`` from sums by ``keys``, ``minutes`` from the KPI table."""

    keys: str | None
    days: tuple[str, ...]
    hours: tuple[Hour, ...]
    minutes: tuple[Hour, ...]


def route(
    spark: SparkSession, out: str, needed: Sequence[str], start: datetime | str | None, end: datetime | str | None
) -> Route:
    """The coarsest tables that have the columns ``needed``: whole days, then whole hours, then minutes."""
    now, noted = _signatures(spark, out), _noted(spark, out)
    first, last = (None if t is None else as_utc(t) for t in (start, end))
    by_hour = "kpi_hour" in needed
    keys = next((k for k, c in KEY_SETS.items() if set(needed) - set(_HOUR) <= set(c)), None)

    def begin(hour: Hour) -> datetime:
        return datetime.combine(date.fromisoformat(hour[0]), datetime.min.time()) + timedelta(hours=hour[1])

    def whole(since: datetime, until: datetime) -> bool:
        return (first is None or first <= since) and (last is None or until <= last)

    meets = [h for h in now if (first is None or begin(h) + timedelta(hours=1) > first) and (last is None or begin(h) < last)]
    summed = {h for h in meets if keys and noted.get(h) == now[h] and whole(begin(h), begin(h) + timedelta(hours=1))}
    of_day: dict[str, set[Hour]] = {}
    for h in {*now, *noted}:
        of_day.setdefault(h[0], set()).add(h)
    days = set()
    for day in {h[0] for h in summed}:
        midnight = begin((day, 0))
        if not by_hour and whole(midnight, midnight + timedelta(days=1)) and of_day[day] <= summed:
            days.add(day)
    hours = sorted(h for h in summed if h[0] not in days)
    return Route(keys, tuple(sorted(days)), tuple(hours), tuple(sorted(set(meets) - summed)))


def summarise_rolled(
    spark: SparkSession,
    out: str,
    dims: Mapping[str, DataFrame],
    by: Sequence[str],
    *,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    where: Column | None = None,
    where_on: Sequence[str] = (),
    having: Column | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``star.summarise`` of the KPI table below ``out`` in ``[start, end)``, from the coarsest sums that answer it.

    ``by`` and ``where_on`` may name attributes, KPI keys, kpi_date and kpi_hour. A ``where`` that speaks of anything
    else, such as a measure of single KPI rows, is answered from the KPI table. An empty KPI table gives no rows.
    """
    needed = list(dict.fromkeys(key_of(c) for c in [*by, *where_on]))
    plan = route(spark, out, needed, start, end)
    kpi = spark.read.parquet(f"{out}/minute_kpi")
    single = where is not None and not tells(where, needed, where_on, dims, kpi)
    if single or plan.keys is None:
        rows = between(kpi.where(_in_hours([*plan.minutes, *plan.hours, *_hours_of_days(spark, out, plan.days)])), start, end)
        return summarise(rows, dims, by, where=where, where_on=where_on, having=having, max_bytes=max_bytes)
    parts = []
    if plan.days:
        day = spark.read.parquet(_table(out, "day", plan.keys))
        parts.append(day.where(F.col("kpi_date").isin([date.fromisoformat(d) for d in plan.days])))
    if plan.hours:
        parts.append(spark.read.parquet(_table(out, "hour", plan.keys)).where(_in_hours(plan.hours)))
    if plan.minutes or not parts:
        rows = between(kpi.where(_in_hours(plan.minutes)), start, end)
        parts.append(aggregate(rows, needed, measures()))
    names = [*needed, *measures()]
    united = parts[0].select(*names)
    for part in parts[1:]:
        united = united.unionByName(part.select(*names))
    return summarise(united, dims, by, where=where, where_on=where_on, having=having, max_bytes=max_bytes, summed=True)


def _hours_of_days(spark: SparkSession, out: str, days: Sequence[str]) -> list[Hour]:
    return [h for h in _signatures(spark, out) if h[0] in days] if days else []
