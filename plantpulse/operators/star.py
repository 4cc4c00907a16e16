"""Dashboard queries: the KPI fact joined with its dimensions, filtered, grouped, filtered again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.timing import timestamp_literal
from plantpulse.operators.kpi import KPI_MINUTE
from plantpulse.operators.lookup import BROADCAST_BYTES, attach, measured_bytes

#: Key and attributes a dimension adds to the fact. A dimension's own factory_id is left out: the
#: factory of a KPI row is the machine's.
ATTRIBUTES = {
    "dim_factory": ("factory_id", ("factory_name", "city", "country", "timezone", "capacity_class")),
    "dim_machine": ("machine_id", ("machine_name", "line_code", "line_name", "product_family",
                                   "machine_type", "vendor", "install_date", "criticality")),
    "dim_operator": ("operator_id", ("operator_name", "experience_level", "shift_pattern")),
    "dim_product": ("product_id", ("sku", "product_name", "category", "brand", "pack_size_g")),
    "dim_sensor_type": ("sensor_type_id", ("sensor_type_code", "sensor_type_name", "unit")),
}

_OWNER = {a: dim for dim, (_, attributes) in ATTRIBUTES.items() for a in attributes}


def between(kpi: DataFrame, start: datetime | str | None, end: datetime | str | None) -> DataFrame:
    """KPI rows of the time range ``[start, end)``."""
    if start is not None:
        kpi = kpi.where(F.col(KPI_MINUTE) >= timestamp_literal(start))
    if end is not None:
        kpi = kpi.where(F.col(KPI_MINUTE) < timestamp_literal(end))
    return kpi


def _parts(dims: Mapping[str, DataFrame], attributes: Sequence[str]) -> dict[str, DataFrame]:
    """Key and wanted attributes of every dimension that holds some."""
    owners = dict.fromkeys(_OWNER[a] for a in attributes)
    return {d: dims[d].select(ATTRIBUTES[d][0], *[a for a in attributes if _OWNER[a] == d]) for d in owners}


def _joined(fact: DataFrame, parts: Mapping[str, DataFrame], small: Mapping[str, bool]) -> DataFrame:
    for dim, part in parts.items():
        fact = attach(fact, part, ATTRIBUTES[dim][0], broadcast=small[dim])
    return fact


def _small(parts: Mapping[str, DataFrame], max_bytes: int) -> dict[str, bool]:
    return {dim: size <= max_bytes for dim, size in measured_bytes(parts).items()} if parts else {}


def star(
    kpi: DataFrame,
    dims: Mapping[str, DataFrame],
    attributes: Sequence[str] | None = None,
    *,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """KPI rows with the asked-for attributes; only the dimensions that hold them are joined."""
    parts = _parts(dims, list(_OWNER) if attributes is None else attributes)
    return _joined(kpi, parts, _small(parts, max_bytes))


def measures() -> dict[str, Column]:
    """The facts a dashboard shows, as aggregates over KPI rows."""
    return {
        "kpi_rows": F.count(F.lit(1)),
        "num_events": F.sum("num_events"),
        "num_alerts": F.sum("num_alerts"),
        "planned_downtime": F.sum("planned_downtime_sec"),
        "unplanned_downtime": F.sum("unplanned_downtime_sec"),
        "min_reading": F.min("min_reading"),
        "max_reading": F.max("max_reading"),
    }


def combined() -> dict[str, Column]:
    """The same facts from rows that hold them already for parts of a group."""
    how = {"min_reading": F.min, "max_reading": F.max}
    return {name: how.get(name, F.sum)(name) for name in measures()}


def aggregate(rows: DataFrame, by: Sequence[str], facts: Mapping[str, Column]) -> DataFrame:
    return rows.groupBy(*by).agg(*[fact.alias(name) for name, fact in facts.items()])


def tells(condition: Column, keys: Sequence[str], where_on: Sequence[str], dims: Mapping[str, DataFrame], rows: DataFrame) -> bool:
    """Whether ``condition`` speaks of ``keys`` and of the attributes ``where_on`` alone; ``rows`` have the keys."""
    parts = _parts(dims, [a for a in where_on if a in _OWNER])
    # an empty table of these columns: a filter on a projection may reach for columns below it
    bare = rows.sparkSession.createDataFrame([], rows.select(*keys).schema)
    return _resolves(condition, _joined(bare, parts, dict.fromkeys(parts, True)))


def key_of(name: str) -> str:
    """The KPI key that tells an attribute, or the column itself."""
    return ATTRIBUTES[_OWNER[name]][0] if name in _OWNER else name


def _resolves(condition: Column, rows: DataFrame) -> bool:
    """Whether ``condition`` can be told from the columns of ``rows``."""
    try:
        rows.where(condition)
    except AnalysisException:
        return False
    return True


def summarise(
    kpi: DataFrame,
    dims: Mapping[str, DataFrame],
    by: Sequence[str],
    *,
    where: Column | None = None,
    where_on: Sequence[str] = (),
    having: Column | None = None,
    max_bytes: int = BROADCAST_BYTES,
    summed: bool = False,
) -> DataFrame:
    """Measures grouped by attributes or KPI keys; ``where`` filters on those and on the attributes
    named by ``where_on``.

    With small dimensions, KPI rows are joined and grouped in one shuffle. If one is too large to
    broadcast, rows are first summed up per combination of the join keys, and only the sums go
    through the joins; unless ``where`` speaks of single KPI rows, as a filter on a measure does. ``summed``: rows hold
    the measures of several KPI rows already, under the names of ``measures``.
    """
    parts = _parts(dims, [a for a in dict.fromkeys([*by, *where_on]) if a in _OWNER])
    small = _small(parts, max_bytes)
    rows, facts = kpi, combined() if summed else measures()
    plain = [c for c in [*by, *where_on] if c not in _OWNER]
    keys = dict.fromkeys([*[ATTRIBUTES[d][0] for d in parts], *plain])
    if not all(small.values()) and (where is None or _resolves(where, _joined(kpi.select(*keys), parts, small))):
        rows, facts = aggregate(kpi, list(keys), facts), combined()
    rows = _joined(rows, parts, small)
    if where is not None:
        rows = rows.where(where)
    out = aggregate(rows, by, facts)
    return out if having is None else out.where(having)
