"""Repeated passages over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sundown.llm.substrings import remove_repeats
from sundown.sources.tables import Tables


def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(Tables(spark, folder).documents)


QUERIES = {"op13_substring_dedup": op13_substring_dedup}
ORACLES: dict[str, str] = {}
