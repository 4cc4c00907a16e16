"""Compare catalog queries with their SQL on the same tables: columns, rows and values."""

from __future__ import annotations

import os

import duckdb
from pyspark.sql import DataFrame, SparkSession

from plantpulse.plans.catalog import queries
from plantpulse.plans.oracle import oracle_sql


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        name = f.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def _sorted(rows: list[tuple]) -> list[str]:
    return sorted(repr(r) for r in rows)


def spark_rows(df: DataFrame) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    return names, _sorted([tuple(r) for r in df.select(names).collect()])


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[str]]:
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    rows = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    return [columns[i] for i in order], _sorted(rows)


def mismatch(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str | None:
    """Description of the first difference; None if both agree."""
    have = spark_rows(queries()[name](spark, sf_dir))
    want = sql_rows(con, oracle_sql()[name])
    if have[0] != want[0]:
        return f"columns {have[0]} != {want[0]}"
    if len(have[1]) != len(want[1]):
        return f"rows {len(have[1])} != {len(want[1])}"
    for a, b in zip(have[1], want[1]):
        if a != b:
            return f"{a} != {b}"
    return None
