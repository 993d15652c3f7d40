"""Digests of values and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What follows a value's length, and what stands for null.
LENGTH_END = ":"
NULL_MARK = "~"


def row_text(columns: Sequence[str]) -> Column:
    """One unambiguous text per row: every value after its length in characters, null as a mark that no length is."""

    def part(column: str) -> Column:
        value = F.col(column).cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(LENGTH_END), value), F.lit(NULL_MARK))

    return F.concat(*[part(c) for c in columns])


def digest(value: Column | str) -> Column:
    """``sha256:`` plus the hexadecimal digest."""
    column = F.col(value) if isinstance(value, str) else value
    return F.concat(F.lit("sha256:"), F.sha2(column, 256))


def row_number_hash(columns: Sequence[str]) -> Column:
    """The first 60 bits of the row's SHA-256, as a bigint."""
    return F.conv(F.substring(F.sha2(row_text(columns), 256), 1, 15), 16, 10).cast("bigint")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Content fingerprint that does not depend on row order: one row per table."""
    names = sorted(columns or df.columns)
    return df.select(row_number_hash(names).alias("h")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
    )
