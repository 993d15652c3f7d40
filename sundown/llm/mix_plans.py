"""The mix of sources over ``documents``, url verdicts over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sundown.llm.mixing import mixed_documents
from sundown.llm.url_filter import url_verdicts
from sundown.sources.tables import Tables


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_documents(Tables(spark, folder).documents)


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_verdicts(Tables(spark, folder).pages).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op6_mixing": op6_mixing, "op3_url_filter": op3_url_filter}
ORACLES: dict[str, str] = {}
