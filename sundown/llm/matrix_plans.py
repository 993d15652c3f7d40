"""Whitening over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sundown.llm.whitening import whiten
from sundown.sources.tables import Tables


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(Tables(spark, folder).embeddings)


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
