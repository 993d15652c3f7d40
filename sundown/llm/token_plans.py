"""Token files and packed sequences over ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sundown.llm import tokens
from sundown.llm.packing import pack
from sundown.sources.tables import Tables

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = tokens.with_crc32(pack(Tables(spark, folder).documents, VOCABULARY))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = tokens.fresh_folder(spark, "tokens")
    tokens.write_token_files(Tables(spark, folder).documents, path, VOCABULARY)
    return tokens.with_crc32(tokens.read_token_files(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op2_packing": op2_packing, "op7_token_files": op7_token_files}
ORACLES: dict[str, str] = {}
