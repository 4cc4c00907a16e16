"""JDBC options for a relational warehouse, for reading and writing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from plantpulse.constants import WAREHOUSE_BATCH_ROWS


@dataclass(frozen=True)
class Warehouse:
    """Address and credentials of a JDBC warehouse."""

    url: str
    user: str
    password: str = field(repr=False)
    driver: str = "org.postgresql.Driver"
    batch_rows: int = WAREHOUSE_BATCH_ROWS

    def properties(self) -> dict[str, str]:
        return {"user": self.user, "password": self.password, "driver": self.driver}

    def write_properties(self, replace: bool) -> dict[str, str]:
        """Rows go in batches; a replaced table is truncated, which keeps its types and keys."""
        extra = {"batchsize": str(self.batch_rows)}
        if replace:
            extra["truncate"] = "true"
        return self.properties() | extra

    def read(
        self,
        spark: SparkSession,
        table: str,
        *,
        split_on: str | None = None,
        lower: int = 0,
        upper: int = 0,
        partitions: int = 1,
    ) -> DataFrame:
        """``table``; a large one is read in parallel by ranges of the numeric column ``split_on``
        (rows outside the range are read too)."""
        if split_on is None:
            return spark.read.jdbc(self.url, table, properties=self.properties())
        return spark.read.jdbc(
            self.url,
            table,
            column=split_on,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=partitions,
            properties=self.properties(),
        )

    def append(self, df: DataFrame, table: str) -> None:
        df.write.jdbc(self.url, table, mode="append", properties=self.write_properties(False))

    def replace(self, df: DataFrame, table: str) -> None:
        df.write.jdbc(self.url, table, mode="overwrite", properties=self.write_properties(True))
