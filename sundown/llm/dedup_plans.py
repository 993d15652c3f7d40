"""Exact and near duplicates over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sundown.llm.exact_dedup import exact_duplicates
from sundown.llm.near_dedup import near_duplicates
from sundown.sources.tables import Tables


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(Tables(spark, folder).documents)


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(Tables(spark, folder).documents)


QUERIES = {"op1_near_dedup": op1_near_dedup, "op8_exact_dedup": op8_exact_dedup}

ORACLES = {
    "op8_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)
    """,
}
