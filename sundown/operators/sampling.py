"""Seeded samples, relationship-closed slices and planted faults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sundown.session import cut_lineage
from sundown.vocabulary import FAULTS, UNMAPPED_VALUE


def order_hash(key: str, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def stable_sample(df: DataFrame, key: str, seed: int, limit: int | Column | None = None) -> DataFrame:
    """The first ``limit`` distinct keys in the order of their seeded hash.

    ``limit`` may be a column over ``total`` (the number of distinct keys), so a share
    of the table needs no count beforehand. A large sample never goes through one
    task: a histogram over the first 16 bits of the hash finds the bucket where the
    limit falls, and only that bucket is ranked.
    """
    hashed = df.select(F.col(key)).distinct().withColumn("order_hash", order_hash(key, seed))
    if limit is None:
        return hashed
    bucketed = hashed.withColumn("_bucket", F.substring("order_hash", 1, 4))
    ordered = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # at most 65,536 rows
    wanted = F.lit(limit) if isinstance(limit, int) else limit
    histogram = (
        bucketed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("total", F.sum("_size").over(W.partitionBy()))
        .withColumn("_left", wanted - F.coalesce(F.sum("_size").over(ordered), F.lit(0)))
        .filter(F.col("_left") > 0)
        .select("_bucket", "_size", "_left")
    )
    # 65,536 histogram rows at most, whatever the table holds.
    marked = bucketed.join(F.broadcast(histogram), "_bucket")
    whole = marked.filter(F.col("_left") >= F.col("_size"))
    ranked = (
        marked.filter(F.col("_left") < F.col("_size"))
        .withColumn("_rank", F.row_number().over(W.partitionBy("_bucket").orderBy("order_hash", F.col(key).cast("string"))))
        .filter(F.col("_rank") <= F.col("_left"))
    )
    return whole.select(key, "order_hash").unionByName(ranked.select(key, "order_hash"))


def one_percent() -> Column:
    """At least one key, else one in a hundred of the distinct keys."""
    return F.greatest(F.lit(1), F.floor(F.col("total") / F.lit(100)))


@dataclass(frozen=True)
class Keep:
    """Keep the rows of ``table`` whose ``column`` occurs in any of ``sources`` (kept table, column)."""

    table: str
    column: str
    sources: tuple[tuple[str, str], ...]


def closed_slice(
    tables: Mapping[str, DataFrame], root: str, roots: DataFrame, root_key: str, rules: Sequence[Keep]
) -> dict[str, DataFrame]:
    """Rows reachable from the sampled roots, so that no kept row has a dangling key.

    The slice is the result, and later rules read the keys of earlier tables, so each
    kept table is written to the shared folder once.
    """
    kept = {root: cut_lineage(tables[root].join(roots.select(root_key), root_key, "left_semi"))}
    for rule in rules:
        keys: DataFrame | None = None
        for table, column in rule.sources:
            part = kept[table].select(F.col(column).alias(rule.column)).filter(F.col(rule.column).isNotNull())
            keys = part if keys is None else keys.unionByName(part)
        kept[rule.table] = cut_lineage(tables[rule.table].join(keys.distinct(), rule.column, "left_semi"))
    return kept


def with_legacy(df: DataFrame, legacy: str, replacement: str) -> DataFrame:
    """Duplicate the replacement column as the legacy column."""
    return df.withColumn(legacy, F.col(replacement))


def next_status(df: DataFrame, column: str) -> DataFrame:
    """Every distinct status with its successor in sorted order, the last one wrapping to the first."""
    distinct = df.select(F.col(column).cast("string").alias("_status")).distinct()
    ordered = W.orderBy("_status")
    return distinct.select(
        "_status",
        F.coalesce(
            F.lead("_status").over(ordered),
            F.first("_status").over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        ).alias("_next"),
    )


def sample_border(df: DataFrame, key: str, seed: int, limit: int | Column) -> DataFrame:
    """The place of the last sampled key in the seeded order, as one row and column."""
    return stable_sample(df, key, seed, limit).agg(F.max(_place(key, F.col("order_hash"))).alias("border"))


def _place(key: str, hashed: Column) -> Column:
    return F.struct(hashed.alias("h"), F.col(key).cast("string").alias("k"))


def inject_fault(df: DataFrame, key: str, column: str, variant: str, seed: int) -> DataFrame:
    """One variant of the table: a stable one percent of its rows gets the fault, ``affected`` marks them.

    A row is hit when its own place in the seeded order lies within the border of the
    sample. The border is a scalar subquery over the keys, so the table itself is
    neither shuffled nor joined.
    """
    salt, _ = FAULTS[variant]
    border = sample_border(df, key, seed + salt, one_percent()).scalar()
    hit = F.coalesce(_place(key, order_hash(key, seed + salt)) <= border, F.lit(False))
    marked = df.withColumn("affected", hit)
    if variant == "null-inflated":
        value = F.when(F.col("affected"), F.lit(None)).otherwise(F.col(column))
    elif variant == "unmapped-value":
        value = F.when(F.col("affected"), F.lit(UNMAPPED_VALUE)).otherwise(F.col(column))
    else:
        # Only affected rows look a successor up; the others carry no join key.
        marked = marked.withColumn("_status", F.when(F.col("affected"), F.col(column).cast("string")))
        marked = marked.join(next_status(df, column), "_status", "left")
        value = F.when(F.col("affected"), F.col("_next")).otherwise(F.col(column))
    return marked.select(
        F.lit(variant).alias("variant_id"),
        *[value.alias(c) if c == column else F.col(c) for c in df.columns],
        "affected",
    )


def inject_nulls(df: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    return inject_fault(df, key, column, "null-inflated", seed)


def inject_semantic_drift(df: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    return inject_fault(df, key, column, "semantic-drift", seed)


def inject_unmapped(df: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    return inject_fault(df, key, column, "unmapped-value", seed)


def fault_variants(df: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    """All variants, one below the other."""
    result: DataFrame | None = None
    for variant in FAULTS:
        part = inject_fault(df, key, column, variant, seed)
        result = part if result is None else result.unionByName(part)
    return result


def fault_manifest(variants: DataFrame, field: str, consumer: str) -> DataFrame:
    """Per variant: how many rows were hit, the rate over all rows, what was done and who is hit.

    The ids of the affected rows stay rows: :func:`fault_rows`.
    """
    mutation = F.create_map(*[F.lit(x) for v, (_, m) in FAULTS.items() for x in (v, m)])
    hit = F.count_if("affected")
    return variants.groupBy("variant_id").agg(
        hit.alias("affected_count"),
        F.round(hit / F.count(F.lit(1)), 8).alias("affected_rate"),
    ).select(
        "variant_id",
        "affected_count",
        "affected_rate",
        F.lit(field).alias("field"),
        mutation[F.col("variant_id")].alias("mutation"),
        F.lit(consumer).alias("impact"),
    )


def fault_rows(variants: DataFrame, key: str) -> DataFrame:
    return variants.filter("affected").select("variant_id", F.col(key).alias("row_id"))
