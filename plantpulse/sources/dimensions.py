"""Dimension tables from CSV, JSON records or a warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.schemas import DIMENSIONS


def to_schema(df: DataFrame, name: str) -> DataFrame:
    """Columns of dimension ``name``, found by name and cast; others are dropped."""
    missing = [f.name for f in DIMENSIONS[name].fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in DIMENSIONS[name].fields])


def read_csv(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Dimension from CSV with a header line. The header decides which column is which."""
    return to_schema(spark.read.option("header", True).csv(path), name)


def read_json_records(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Dimension from a file holding one JSON array of records."""
    return spark.read.schema(DIMENSIONS[name]).option("multiLine", True).json(path)


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    return to_schema(spark.read.format(fmt).load(path), name)


def replace_dimension(df: DataFrame, name: str, path: str) -> None:
    """Replace the stored dimension ``name`` by ``df``."""
    to_schema(df, name).write.mode("overwrite").parquet(path)
