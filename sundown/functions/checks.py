"""Ordered checks: the first failing one names the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_code(checks: Sequence[tuple[Column, str]]) -> Column:
    """Code of the first check whose failure condition holds, else null."""
    return F.coalesce(*[F.when(failed, F.lit(code)) for failed, code in checks])


def differs(left: Column | str, right: Column | str) -> Column:
    """``IS DISTINCT FROM``."""
    a = F.col(left) if isinstance(left, str) else left
    b = F.col(right) if isinstance(right, str) else right
    return ~a.eqNullSafe(b)


def not_true(value: Column | str) -> Column:
    """False or unknown."""
    column = F.col(value) if isinstance(value, str) else value
    return ~F.coalesce(column, F.lit(False))


def count_where(condition: Column) -> Column:
    """Number of rows meeting the condition; 0 on empty input."""
    return F.coalesce(F.count_if(condition), F.lit(0)).cast("bigint")


def first_failure(failures: DataFrame, keys: Sequence[str], order: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """The earliest failure row per key, by partial aggregation instead of a window."""
    spot = F.struct(*[F.col(c) for c in order])
    return (
        failures.groupBy(*keys)
        .agg(F.min_by(F.struct(*[F.col(c) for c in kept]), spot).alias("_f"))
        .select(*keys, "_f.*")
    )
