"""Parquet tables of one folder, opened on first use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """``tables.orders`` reads ``<folder>/orders.parquet``; nothing is read until an action needs it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._opened: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._opened[name]


def write_result(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write one result as parquet, replacing an earlier run of the same result."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
