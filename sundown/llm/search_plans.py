"""Exact top-k search over ``embeddings``, surrogates over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sundown.llm.pii import pseudonymised_documents
from sundown.llm.top_k import top_k
from sundown.sources.tables import Tables

# The key decides the surrogates; a production run passes its own secret.
EXAMPLE_KEY = b"surrogates of the example run"


def op4_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = Tables(spark, folder).embeddings
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymised_documents(Tables(spark, folder).documents, EXAMPLE_KEY)


QUERIES = {"op4_top_k": op4_top_k, "op10_pii": op10_pii}
ORACLES: dict[str, str] = {}
