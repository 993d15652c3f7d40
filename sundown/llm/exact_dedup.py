"""Exact duplicates by content-defined chunk recipes.

A text is normalised (every run of white space is one space), cut where a rolling hash of its
last 32 bytes hits a mask, and written down as the ordered list of its chunks' identifiers. An
identifier is a 64-bit hash and a length; a dictionary that meets every distinct chunk once
verifies that the bytes behind an identifier agree. Texts are equal when their ordered lists are
equal; only lists that hold an identifier with several contents also compare the SHA-256 of the
whole text. So a long text's bytes move once, as chunks that copies share, and everything after
that moves lists of numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.llm.common import SPACE, fresh, map_batches, raw_text
from sundown.session import cut_lineage

WINDOW = 32
MASK_BITS = 11  # a border every 2,048 bytes on average
LEAST_BYTES = 256
MOST_BYTES = 16_384

_GEAR = np.random.default_rng(20_240).integers(0, 1 << 32, 256, dtype=np.uint32)
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normalise(text: bytes) -> bytes:
    """Every run of ASCII white space as one space."""
    text = text.translate(_BLANKS)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def borders(text: bytes) -> list[int]:
    """Ends of the chunks of one text; the last is its length. An empty text has none."""
    size = len(text)
    if size <= LEAST_BYTES:
        return [size] if size else []
    rolling = _GEAR[np.frombuffer(text, np.uint8)]
    step = 1
    while step < WINDOW:
        rolling[step:] += rolling[:-step] << np.uint32(step)
        step *= 2
    # The hash sits in the high bits, where every byte of the window has an effect.
    hits = np.flatnonzero(rolling >> np.uint32(32 - MASK_BITS) == 0) + 1
    ends: list[int] = []
    start = 0
    for hit in hits[hits >= LEAST_BYTES].tolist():
        while hit - start > MOST_BYTES:
            start += MOST_BYTES
            ends.append(start)
        if hit - start >= LEAST_BYTES and hit < size:
            ends.append(hit)
            start = hit
    while size - start > MOST_BYTES:
        start += MOST_BYTES
        ends.append(start)
    return [*ends, size] if start < size else ends


def _chunks(text: bytes) -> list[bytes]:
    start, out = 0, []
    for end in borders(text):
        out.append(text[start:end])
        start = end
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _identifier(chunk: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(chunk, len(chunk)))


def _recipes(batch: pa.RecordBatch) -> pa.RecordBatch:
    shas, lists = [], []
    for text in batch.column("text").to_pylist():
        text = normalise(text)
        shas.append(hashlib.sha256(text).hexdigest())
        lists.append([_identifier(c) for c in _chunks(text)])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(shas), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "text_sha256", "recipe"]
    )


def _contents(batch: pa.RecordBatch) -> pa.RecordBatch:
    chunks = [c for text in batch.column("text").to_pylist() for c in _chunks(normalise(text))]
    return pa.RecordBatch.from_arrays(
        [pa.array([_identifier(c) for c in chunks], pa.int64()), pa.array(chunks, pa.binary())], ["identifier", "content"]
    )


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_sha256, recipe) of every row."""
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), raw_text(text).alias("text"))
    return map_batches(source, _recipes, "doc_id bigint, text_sha256 string, recipe array<bigint>")


def ambiguous_identifiers(docs: DataFrame, text: str = "text") -> DataFrame:
    """Identifiers behind which the dictionary found more than one content."""
    chunks = map_batches(docs.select(raw_text(text).alias("text")), _contents, "identifier bigint, content binary")
    dictionary = chunks.groupBy("identifier").agg(F.min("content").alias("least"), F.max("content").alias("most"))
    return dictionary.filter("least <> most").select("identifier")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; all empty texts form one group. Of equal texts the smallest
    doc_id stays; rows that repeat both doc_id and text are all ``kept``. A row without doc_id
    counts in its group, and stays only if its group has no doc_id at all. An empty table gives
    no rows; other columns are ignored.
    """
    listed = cut_lineage(recipes(docs, doc_id, text).withColumn("recipe_hash", F.xxhash64("recipe")))
    unsure = (
        listed.select("recipe_hash", F.explode("recipe").alias("identifier"))
        .join(ambiguous_identifiers(docs, text), "identifier", "left_semi")
        .select("recipe_hash")
        .distinct()
        .withColumn("unsure", F.lit(True))
    )
    marked = listed.join(unsure, "recipe_hash", "left").withColumn(
        "settled", F.when(F.col("unsure"), F.col("text_sha256")).otherwise(F.lit(""))
    )
    key = ["recipe_hash", "recipe", "settled"]
    groups = marked.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return marked.join(groups, key).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns, whatever their names.

    Null and empty texts are one group. Rows that repeat doc_id and text are one; a row without
    doc_id stays only where its whole group has none. An empty table stays empty.
    """
    of, sha = fresh(docs, "exact_id"), fresh(docs, "exact_sha")
    stays = (
        exact_duplicates(docs, doc_id, text).filter("kept").select(_named("doc_id").alias(of), F.col("text_sha256").alias(sha)).distinct()
    )
    blanks = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")
    hashed = docs.withColumns({of: _named(doc_id), sha: F.sha2(blanks.cast("binary"), 256)})
    # The join has dealt the rows by both keys, so repeated rows go without another shuffle.
    return hashed.join(stays, [of, sha], "left_semi").dropDuplicates([of, sha]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _named(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("bigint").cast("string"), F.lit(""))
