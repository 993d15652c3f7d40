"""Ordered computations that survive one key holding most of the rows.

A window partitioned by a hot key puts the whole key into one task. These helpers
split each key into consecutive chunks, run the window inside a chunk, and carry one
summary row per chunk forward. ``chunk`` must grow with the order, e.g. the sequence
divided by a constant or the hour of a timestamp.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sundown.session import cut_lineage

CHUNK_ROWS = 65_536
FINER = 10  # bits by which a slice with too many rows is cut
TIME_BITS = 30  # of microseconds: slices of 18 minutes to begin with


def sequence_chunk(column: str = "sequence", rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a dense 1-based sequence."""
    return F.floor(F.col(column) / F.lit(rows))


def before_each_row(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    *,
    last: Mapping[str, Column] | None = None,
    first: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    include_current: bool = False,
) -> DataFrame:
    """Add, per row, the last / first non-null value and the sum over all earlier rows of its key."""
    last, first, total = last or {}, first or {}, total or {}
    source = df.withColumn("_chunk", chunk)
    for name, value in {**last, **first, **total}.items():
        source = source.withColumn(f"_v_{name}", value)

    spot = F.struct(*[F.col(c) for c in order])
    summary = source.groupBy(*keys, "_chunk").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), spot)).alias(f"_s_{n}") for n in last],
        *[F.min_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), spot)).alias(f"_s_{n}") for n in first],
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in total],
    )
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = summary.select(
        *keys,
        "_chunk",
        *[F.last(f"_s_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in last],
        *[F.first(f"_s_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in first],
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in total],
    )

    frame = (
        W.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
    )
    local = source
    for n in last:
        local = local.withColumn(f"_l_{n}", F.last(f"_v_{n}", ignorenulls=True).over(frame))
    for n in first:
        local = local.withColumn(f"_l_{n}", F.first(f"_v_{n}", ignorenulls=True).over(frame))
    for n in total:
        local = local.withColumn(f"_l_{n}", F.sum(f"_v_{n}").over(frame))

    zero = F.lit(0)
    return local.join(carry, [*keys, "_chunk"], "left").select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in last],
        *[F.coalesce(f"_c_{n}", f"_l_{n}").alias(n) for n in first],
        *[(F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_c_{n}"), zero)).alias(n) for n in total],
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], name: str = "position"
) -> DataFrame:
    """1-based position of every row inside its key, without one task per key."""
    numbered = before_each_row(
        df, keys, chunk, order, total={name: F.lit(1).cast("bigint")}, include_current=True
    )
    return numbered


def range_row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", slices: int | None = None
) -> DataFrame:
    """Like :func:`row_numbers` for an order that offers no natural chunk, such as text ids.

    Rows are range-partitioned on key and order; the slice number is written to the
    checkpoint folder first, so that both branches below see the same slices even
    when a lost task is run again.
    """
    spark = df.sparkSession
    count = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut_lineage(
        df.repartitionByRange(count, *keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    return row_numbers(sliced, keys, F.col("_slice"), order, name).drop("_slice")


def _without_maps(schema: T.DataType) -> bool:
    if isinstance(schema, T.StructType):
        return all(_without_maps(f.dataType) for f in schema.fields)
    return _without_maps(schema.elementType) if isinstance(schema, T.ArrayType) else not isinstance(schema, T.MapType)


def with_slices(df: DataFrame, keys: Sequence[str], bits: int, rows: int) -> DataFrame:
    """Add ``_from`` and ``_part``: consecutive slices of each key's order, hardly more than ``rows`` rows each.

    ``df`` is a written table with columns ``_position`` (bigint) and ``_tie`` (a hash of 63 bits that
    orders rows of one position). A histogram counts the rows of each key in stretches of 2^``bits``
    positions; stretches with too many are counted again in finer ones, and so on. A single
    position with too many rows, such as a sequence number that repeats, is cut by ``_tie``. Only the
    counts that are too large leave a round, and usually there are none.
    """
    placed, heavy = df.withColumn("_bits", F.lit(bits)), df
    own = [*keys, "_start"]
    start = lambda b: F.expr(f"shiftright(_position, {b})")
    while True:
        counts = heavy.groupBy(*keys, start(bits).alias("_start")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
        large = cut_lineage(counts)
        if large.isEmpty():
            parts = F.lit(0).cast("bigint")
            break
        if bits == 0:
            # Enough parts that each is below the bound on average by a half.
            parted = large.select(*own, F.ceil(F.log2(2 * F.col("_n") / rows)).cast("int").alias("_part_bits"))
            placed = placed.withColumn("_start", F.col("_position")).join(parted, own, "left").drop("_start")
            parts = F.coalesce(F.expr("shiftright(_tie, 63 - _part_bits)"), F.lit(0).cast("bigint"))
            break
        finer = max(0, bits - FINER)
        heavy = heavy.withColumn("_start", start(bits)).join(large.select(*own), own, "left_semi").drop("_start")
        placed = placed.withColumn("_start", start(bits)).join(large.select(*own, F.lit(finer).alias("_finer")), own, "left").withColumn(
            "_bits", F.least("_bits", "_finer")).drop("_finer", "_start")
        bits = finer
    sliced = placed.withColumn("_from", F.expr("shiftleft(shiftright(_position, _bits), _bits)")).withColumn("_part", parts)
    return sliced.drop("_bits", "_part_bits")


def sliced_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    position: Column | None = None,
    bits: int = 16,
    rows: int = CHUNK_ROWS,
    last: Mapping[str, Column] | None = None,
    first: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    least: Mapping[str, Column] | None = None,
    include_current: bool = False,
) -> DataFrame:
    """Add, per row, the last / first non-null value, the sum and the least value over all earlier rows of its key.

    ``position`` is a number that never falls along ``order``, by default the first column of it.
    The input is evaluated once and written to the shared folder; all folds share its slices, and
    one summary row a slice is carried forward. Rows that ``order`` does not tell apart are ordered
    by a hash of their values.
    """
    last, first, total, least = last or {}, first or {}, total or {}, least or {}
    folds = {**last, **first, **total, **least}
    tie = [f.name for f in df.schema.fields if _without_maps(f.dataType)]
    source = cut_lineage(
        df.select(
            "*", *[value.alias(f"_v_{name}") for name, value in folds.items()],
            (F.col(order[0]) if position is None else position).cast("bigint").alias("_position"), F.shiftrightunsigned(F.xxhash64(*tie), 1).alias("_tie"),
        )
    )
    sliced = with_slices(source, keys, bits, rows)
    slice_ = [*keys, "_from", "_part"]
    spot = F.struct(*order, "_tie")
    held = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), spot)
    summary = sliced.groupBy(*slice_).agg(
        *[F.max_by(f"_v_{n}", held(n)).alias(f"_s_{n}") for n in last],
        *[F.min_by(f"_v_{n}", held(n)).alias(f"_s_{n}") for n in first],
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in total],
        *[F.min(f"_v_{n}").alias(f"_s_{n}") for n in least],
    )
    earlier = W.partitionBy(*keys).orderBy("_from", "_part").rowsBetween(W.unboundedPreceding, -1)
    frame = W.partitionBy(*slice_).orderBy(*order, "_tie").rowsBetween(W.unboundedPreceding, 0 if include_current else -1)

    def over(prefix: str, window: W) -> list[Column]:
        return [
            *[F.last(f"{prefix}{n}", ignorenulls=True).over(window) for n in last],
            *[F.first(f"{prefix}{n}", ignorenulls=True).over(window) for n in first],
            *[F.sum(f"{prefix}{n}").over(window) for n in total],
            *[F.min(f"{prefix}{n}").over(window) for n in least],
        ]

    names = [*last, *first, *total, *least]
    carry = summary.select(*slice_, *[c.alias(f"_c_{n}") for n, c in zip(names, over("_s_", earlier), strict=True)])
    local = sliced.select(*df.columns, "_from", "_part", *[c.alias(f"_l_{n}") for n, c in zip(names, over("_v_", frame), strict=True)])
    zero = F.lit(0)
    return local.join(carry, slice_, "left").select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in last],
        *[F.coalesce(f"_c_{n}", f"_l_{n}").alias(n) for n in first],
        *[(F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_c_{n}"), zero)).alias(n) for n in total],
        *[F.least(f"_l_{n}", f"_c_{n}").alias(n) for n in least],
    )


def sliced_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", *, position: Column | None = None, bits: int = 16,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """1-based position of every row inside its key, by :func:`sliced_before`."""
    one = F.lit(1).cast("bigint")
    return sliced_before(df, keys, order, position=position, bits=bits, rows=rows, total={name: one}, include_current=True)
