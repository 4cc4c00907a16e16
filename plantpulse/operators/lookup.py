"""Joins of a large fact with lookup tables whose size is measured first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest lookup table, in bytes of JSON text, that is sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024


def measured_bytes(tables: Mapping[str, DataFrame]) -> dict[str, int]:
    """Size of each table as JSON text, measured by one distributed job; one row per table back."""
    sizes = [
        df.select(F.lit(name).alias("name"), F.octet_length(F.to_json(F.struct("*"))).alias("n"))
        for name, df in tables.items()
    ]
    total = reduce(DataFrame.unionAll, sizes).groupBy("name").agg(F.sum("n").alias("n"))
    found = {r["name"]: int(r["n"]) for r in total.collect()}
    return {name: found.get(name, 0) for name in tables}


def fits_broadcast(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    return measured_bytes({"t": table})["t"] <= max_bytes


def attach(
    fact: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    *,
    how: str = "left",
    broadcast: bool | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Equi-join of ``fact`` with ``lookup``: ``how`` is left, inner, left_semi or left_anti.

    ``broadcast=None`` measures the lookup. Small: broadcast, the fact is not shuffled. Large: both sides are shuffled
    once by key, as they are; adaptive execution splits the partition of a key that holds a large share of the fact,
    from sizes it has measured.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    if broadcast is None:
        broadcast = fits_broadcast(lookup, max_bytes)
    if broadcast:
        return fact.join(F.broadcast(lookup), keys, how)
    return fact.hint("merge").join(lookup, keys, how)


def without_identities(readings: DataFrame, ids: DataFrame) -> DataFrame:
    """``readings`` whose ``_id`` is not in ``ids`` (rows without identity stay).

    Both sides can be large and identities are close to unique, so repeating one side per salt
    would cost more than it helps. The choice is left to AQE: it broadcasts ``ids`` if they turn
    out small, and splits a partition that a reading delivered very often has made large.
    """
    return readings.join(ids.select("_id"), "_id", "left_anti")


def only_identities(readings: DataFrame, ids: DataFrame) -> DataFrame:
    """``readings`` whose ``_id`` is in ``ids``; joined like ``without_identities``."""
    return readings.join(ids.select("_id"), "_id", "left_semi")
