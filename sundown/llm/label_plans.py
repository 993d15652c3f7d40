"""Quality and toxicity scores over ``documents``, learned from ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sundown.llm import quality, toxicity
from sundown.sources.tables import Tables


def _judged(scores: DataFrame, modulus: int, held_out: int, border: float) -> DataFrame:
    return scores.select(
        "doc_id",
        (F.coalesce(quality.remainder("doc_id", modulus), F.lit(-1)) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= border).cast("int").alias("predicted"),
    )


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    model = quality.train(t.documents, t.labels, quality.remainder("doc_id", 3) != 1)
    return _judged(quality.score(t.documents, model), 3, 1, 0.5)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    model = toxicity.train(t.documents, t.labels, quality.remainder("doc_id", 4) != 2)
    return _judged(toxicity.score(t.documents, model), 4, 2, 0.3)


QUERIES = {"op5_quality": op5_quality, "op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
