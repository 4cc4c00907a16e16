"""Identifiers of machines and factories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_code(col: Column | str) -> Column:
    """Upper case without surrounding blanks."""
    return F.upper(F.trim(col))
