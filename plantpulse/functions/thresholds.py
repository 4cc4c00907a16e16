"""Static limits per sensor type: which side of the range a reading breaches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE, LOW, HIGH = "reading_value", "typical_min", "typical_max"


def above(value: str = VALUE) -> Column:
    """NULL-safe "over the upper limit"; NaN sorts above every limit."""
    return F.coalesce(F.col(value) > F.col(HIGH), F.lit(False))


def below(value: str = VALUE) -> Column:
    return F.coalesce(F.col(value) < F.col(LOW), F.lit(False))


def breached(value: str = VALUE) -> Column:
    """True outside ``[typical_min, typical_max]``; both bounds and unknown limits are fine."""
    return above(value) | below(value)


def by_side(over: Column | str, under: Column | str) -> Column:
    """``over`` for readings above the range, ``under`` for the other breaches."""
    pick = [c if isinstance(c, Column) else F.lit(c) for c in (over, under)]
    return F.when(above(), pick[0]).otherwise(pick[1])


def two_places(col: Column | str) -> Column:
    return F.round(col, 2).cast("string")


def sentence(*parts: Column | str) -> Column:
    """Text from literal pieces and columns; NULL as soon as one piece is NULL."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
