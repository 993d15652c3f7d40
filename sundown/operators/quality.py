"""Table quality: keys, references, parity, order in time, bounds, distributions and freshness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sundown.functions.checks import count_where, differs
from sundown.functions.hashing import fingerprint
from sundown.session import cut_lineage


@dataclass(frozen=True)
class ForeignKey:
    child: str
    child_columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    nullable: bool = False


@dataclass(frozen=True)
class TemporalRule:
    """``child.later`` must not lie before ``earlier``; with ``parent`` set, ``earlier`` is a parent column."""

    child: str
    later: str
    earlier: str
    parent: str | None = None
    child_key: str | None = None
    parent_key: str | None = None


@dataclass(frozen=True)
class NumericBound:
    table: str
    column: str
    low: float = 0


@dataclass(frozen=True)
class QualityContract:
    primary_keys: Mapping[str, tuple[str, ...]]
    foreign_keys: tuple[ForeignKey, ...] = ()
    pair: tuple[str, str, str] | None = None  # table, legacy column, replacement column
    temporal: tuple[TemporalRule, ...] = ()
    bounds: tuple[NumericBound, ...] = ()


def primary_key_audit(df: DataFrame, key: Sequence[str], table: str) -> DataFrame:
    """Row count, null-or-empty keys and duplicates, from one grouping of the table."""
    empty = F.lit(False)
    for column in key:
        text = F.col(column).cast("string")
        empty = empty | text.isNull() | (text == "")
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("bigint")
    counted = groups.agg(
        F.coalesce(F.sum("_n"), zero).alias("row_count"),
        F.coalesce(F.sum(F.when(empty, F.col("_n"))), zero).alias("null_keys"),
        F.coalesce(F.sum("_n") - F.count(F.lit(1)), zero).alias("duplicate_keys"),
    )
    return counted.select(
        F.lit(table).alias("table_name"),
        "row_count",
        "null_keys",
        "duplicate_keys",
        (F.col("null_keys") + F.col("duplicate_keys")).alias("violations"),
    )


def foreign_key_orphans(tables: Mapping[str, DataFrame], key: ForeignKey) -> DataFrame:
    """Every orphan child key with its number of rows.

    The child is grouped by key before the join, so a hot key is one row by then.
    """
    names = [f"_k{i}" for i in range(len(key.child_columns))]
    child = tables[key.child].select(*[F.col(c).alias(n) for c, n in zip(key.child_columns, names)])
    if key.nullable:
        child = child.dropna(subset=names)
    child = child.groupBy(*names).agg(F.count(F.lit(1)).alias("rows"))
    parent = tables[key.parent].select(
        *[F.col(c).alias(f"_p{n}") for c, n in zip(key.parent_columns, names)]
    ).distinct()
    matched = F.lit(True)
    for name in names:
        matched = matched & F.col(name).eqNullSafe(F.col(f"_p{name}"))
    return child.join(parent, matched, "left_anti")


def foreign_key_audit(tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey]) -> DataFrame:
    """Violations per reference."""
    result: DataFrame | None = None
    for key in keys:
        part = foreign_key_orphans(tables, key).agg(
            F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("violations")
        ).select(
            F.lit(key.child).alias("table_name"),
            F.lit(",".join(key.child_columns)).alias("column_name"),
            F.lit(key.parent).alias("parent_table"),
            "violations",
        )
        result = part if result is None else result.unionByName(part)
    return result


def pair_parity(df: DataFrame, legacy: str, replacement: str) -> DataFrame:
    """Rows where the two columns differ, null counting as a value, and null replacements."""
    return df.agg(
        count_where(differs(legacy, replacement)).alias("mismatches"),
        count_where(F.col(replacement).isNull()).alias("replacement_nulls"),
    )


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; null is shown as ``None``."""
    return (
        df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def value_bounds(df: DataFrame, amount: str, date: str) -> DataFrame:
    """Smallest and largest amount and date; nulls for an empty table."""
    return df.agg(
        F.min(amount).alias("amount_min"),
        F.max(amount).alias("amount_max"),
        F.min(date).alias("date_min"),
        F.max(date).alias("date_max"),
    )


def temporal_audit(tables: Mapping[str, DataFrame], rules: Sequence[TemporalRule]) -> DataFrame:
    """One violation per broken rule and row; a null date breaks nothing."""
    result: DataFrame | None = None
    for rule in rules:
        child = tables[rule.child]
        if rule.parent is None:
            counted = child.agg(count_where(F.col(rule.later) < F.col(rule.earlier)).alias("violations"))
        else:
            # One row per (key, date) before the join keeps a hot key small.
            dated = child.groupBy(F.col(rule.child_key).alias("_key"), F.col(rule.later).alias("_later")).agg(
                F.count(F.lit(1)).alias("_n")
            )
            parent = tables[rule.parent].select(
                F.col(rule.parent_key).alias("_key"), F.col(rule.earlier).alias("_earlier")
            )
            counted = dated.join(parent, "_key").agg(
                F.coalesce(F.sum(F.when(F.col("_later") < F.col("_earlier"), F.col("_n"))), F.lit(0))
                .cast("bigint")
                .alias("violations")
            )
        earlier = rule.earlier if rule.parent is None else f"{rule.parent}.{rule.earlier}"
        part = counted.select(
            F.lit(rule.child).alias("table_name"),
            F.lit(f"{rule.later}<{earlier}").alias("rule"),
            "violations",
        )
        result = part if result is None else result.unionByName(part)
    return result


def numeric_bound_audit(tables: Mapping[str, DataFrame], bounds: Sequence[NumericBound]) -> DataFrame:
    """Rows below the lower bound, per column."""
    result: DataFrame | None = None
    for bound in bounds:
        part = tables[bound.table].agg(count_where(F.col(bound.column) < bound.low).alias("violations")).select(
            F.lit(bound.table).alias("table_name"), F.lit(bound.column).alias("column_name"), "violations"
        )
        result = part if result is None else result.unionByName(part)
    return result


def _metrics(df: DataFrame, check: str, table: Column, column: Column, violations: str) -> DataFrame:
    return df.select(
        F.lit(check).alias("check_name"),
        table.alias("table_name"),
        column.alias("column_name"),
        F.col(violations).cast("bigint").alias("violations"),
    )


def quality_report(tables: Mapping[str, DataFrame], contract: QualityContract) -> DataFrame:
    """Every component count as one row ``(check_name, table_name, column_name, violations)``."""
    parts: list[DataFrame] = []
    for table, key in contract.primary_keys.items():
        audit = primary_key_audit(tables[table], key, table)
        parts.append(_metrics(audit, "primary_key", F.col("table_name"), F.lit(",".join(key)), "violations"))
    if contract.foreign_keys:
        audit = foreign_key_audit(tables, contract.foreign_keys)
        parts.append(_metrics(audit, "foreign_key", F.col("table_name"), F.col("column_name"), "violations"))
    if contract.temporal:
        audit = temporal_audit(tables, contract.temporal)
        parts.append(_metrics(audit, "temporal", F.col("table_name"), F.col("rule"), "violations"))
    # The parity and bound checks of one table share one scan.
    conditions: dict[str, list[tuple[str, str, Column]]] = {}
    if contract.pair:
        table, legacy, replacement = contract.pair
        conditions.setdefault(table, []).extend(
            [
                ("pair_mismatch", replacement, differs(legacy, replacement)),
                ("replacement_null", replacement, F.col(replacement).isNull()),
            ]
        )
    for bound in contract.bounds:
        conditions.setdefault(bound.table, []).append(
            ("numeric_bound", bound.column, F.col(bound.column) < bound.low)
        )
    for table, checks in conditions.items():
        counted = tables[table].agg(
            F.array(
                *[
                    F.struct(
                        F.lit(check).alias("check_name"),
                        F.lit(table).alias("table_name"),
                        F.lit(column).alias("column_name"),
                        count_where(condition).alias("violations"),
                    )
                    for check, column, condition in checks
                ]
            ).alias("_m")
        )
        parts.append(counted.select(F.explode("_m").alias("_m")).select("_m.*"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def quality_gate(report: DataFrame) -> DataFrame:
    """The total, and the refusal code when it is not zero."""
    return report.agg(
        F.coalesce(F.sum("violations"), F.lit(0)).cast("bigint").alias("total_violations")
    ).select(
        "total_violations",
        F.when(F.col("total_violations") != 0, F.lit("VALIDATION_RECEIPT_FAILED")).alias("refusal_code"),
    )


def orphan_probe(
    tables: Mapping[str, DataFrame], relations: Mapping[str, Sequence[tuple[str, str, str]]]
) -> DataFrame:
    """Child rows missing at least one parent, each counted once.

    ``relations`` maps a child to its ``(child column, parent, parent column)`` list.
    """
    result: DataFrame | None = None
    for child, parents in relations.items():
        columns = [c for c, _, _ in parents]
        rows = tables[child].groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        missing = F.lit(False)
        for i, (column, parent, parent_column) in enumerate(parents):
            keys = tables[parent].select(F.col(parent_column).alias(column), F.lit(True).alias(f"_hit{i}"))
            rows = rows.join(keys.distinct(), column, "left")
            missing = missing | F.col(f"_hit{i}").isNull()
        part = rows.agg(
            F.coalesce(F.sum(F.when(missing, F.col("_n"))), F.lit(0)).cast("bigint").alias("orphans")
        ).select(F.lit(child).alias("table_name"), "orphans")
        result = part if result is None else result.unionByName(part)
    return result


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    result: DataFrame | None = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        result = part if result is None else result.unionByName(part)
    return result


@dataclass(frozen=True)
class Branch:
    """Where a branch keeps the observed attributes; a missing attribute is None."""

    name: str
    amount: str | None = None
    person: str | None = None
    age: str | None = None
    admitted: str | None = None
    discharged: str | None = None
    stay_days: str | None = None
    ages: tuple[int, int] = field(default=(0, 120))


# Names of the observed faults.
BRANCH_FAULTS = ("negative_amount", "null_name", "invalid_age", "date_swap", "unparseable")


def branch_fault_counts(tables: Mapping[str, DataFrame], branches: Sequence[Branch]) -> DataFrame:
    """Fault counts of every branch, one scan each; a fault the branch cannot show is null.

    Text that is no number or date is counted as unparseable instead of being guessed.
    """
    result: DataFrame | None = None
    for branch in branches:
        conditions: dict[str, Column] = {}
        unparseable = F.lit(False)

        def parsed(column: str, cast_to: str) -> Column:
            nonlocal unparseable
            value = F.col(column).try_cast(cast_to)
            unparseable = unparseable | (F.col(column).isNotNull() & value.isNull())
            return value

        if branch.amount:
            conditions["negative_amount"] = parsed(branch.amount, "double") < 0
        if branch.person:
            conditions["null_name"] = F.col(branch.person).isNull()
        if branch.age:
            low, high = branch.ages
            age = parsed(branch.age, "int")
            conditions["invalid_age"] = (age < low) | (age > high)
        if branch.admitted and branch.discharged:
            conditions["date_swap"] = parsed(branch.discharged, "date") < parsed(branch.admitted, "date")
        elif branch.stay_days:
            conditions["date_swap"] = parsed(branch.stay_days, "int") < 0
        conditions["unparseable"] = unparseable
        part = tables[branch.name].agg(
            F.count(F.lit(1)).alias("row_count"),
            *[
                (count_where(conditions[f]) if f in conditions else F.lit(None).cast("bigint")).alias(f)
                for f in BRANCH_FAULTS
            ],
        ).select(F.lit(branch.name).alias("branch"), "row_count", *BRANCH_FAULTS)
        result = part if result is None else result.unionByName(part)
    return result


def branch_selectivity(
    counts: DataFrame, tables: Mapping[str, DataFrame], columns: Sequence[str], fault: str
) -> DataFrame:
    """Which columns each branch carries, and whether one fault has the same count in every branch."""
    present = F.lit(None).cast("string")
    for name, df in tables.items():
        held = [c for c in columns if c in df.columns]
        present = F.when(F.col("branch") == name, F.lit(",".join(sorted(held)))).otherwise(present)
    every = W.partitionBy()  # one row per branch
    low, high = F.min(F.coalesce(fault, F.lit(-1))).over(every), F.max(F.coalesce(fault, F.lit(-1))).over(every)
    return counts.select(
        "branch",
        present.alias("columns_present"),
        F.col(fault).alias("fault_count"),
        (low == high).alias("propagates_to_all"),
    )


def layer_freshness(
    layers: Mapping[str, tuple[DataFrame, str]], raw: str, staging: str, documented_gap_days: int
) -> DataFrame:
    """Newest date per layer, the gap between raw and staging, and its distance from the documented gap."""
    result: DataFrame | None = None
    for name, (df, column) in layers.items():
        part = df.agg(
            F.max(F.to_date(column)).alias("max_date"), F.count(F.lit(1)).alias("row_count")
        ).select(F.lit(name).alias("layer"), "max_date", "row_count")
        result = part if result is None else result.unionByName(part)
    newest = {n: F.max(F.when(F.col("layer") == n, F.col("max_date"))) for n in layers}
    return result.agg(
        *[newest[n].alias(f"{n}_max_date") for n in layers],
        *[F.max(F.when(F.col("layer") == n, F.col("row_count"))).alias(f"{n}_rows") for n in layers],
        F.datediff(newest[raw], newest[staging]).alias("gap_days"),
    ).select(
        "*",
        F.lit(documented_gap_days).alias("documented_gap_days"),
        (F.col("gap_days") != documented_gap_days).alias("gap_discrepancy"),
    )


def volume_probe(mart: DataFrame, volume: str) -> DataFrame:
    """Total volume and the number of days without any."""
    return mart.agg(
        F.coalesce(F.sum(volume), F.lit(0)).cast("bigint").alias("total_volume"),
        count_where(F.col(volume) == 0).alias("empty_days"),
    )


@dataclass(frozen=True)
class ColumnTests:
    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    accepted: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


def column_tests(df: DataFrame, tests: ColumnTests, by: Sequence[str] = ()) -> DataFrame:
    """Failing rows per declarative test, optionally per group of ``by``.

    Null passes ``unique`` and ``accepted_values``, as in SQL. ``unique`` counts the
    values that occur more than once.
    """
    entries = [("not_null", c, F.col(c).isNull()) for c in tests.not_null]
    entries += [
        ("accepted_values", c, F.col(c).isNotNull() & ~F.col(c).cast("string").isin(*values))
        for c, values in tests.accepted.items()
    ]
    counted = df.groupBy(*by).agg(
        F.array(
            *[
                F.struct(
                    F.lit(test).alias("test"),
                    F.lit(column).alias("column_name"),
                    count_where(condition).alias("failing_rows"),
                )
                for test, column, condition in entries
            ]
        ).alias("_t")
    )
    result = counted.select(*by, F.explode("_t").alias("_t")).select(*by, "_t.*") if entries else None
    for column in tests.unique:
        repeated = (
            df.groupBy(*by, column)
            .agg(F.count(F.lit(1)).alias("_n"))
            .groupBy(*by)
            .agg(count_where((F.col("_n") > 1) & F.col(column).isNotNull()).alias("failing_rows"))
            .select(*by, F.lit("unique").alias("test"), F.lit(column).alias("column_name"), "failing_rows")
        )
        result = repeated if result is None else result.unionByName(repeated)
    return result


def table_diff(actual: DataFrame, expected: DataFrame, mode: str = "both") -> DataFrame:
    """Rows on which two tables disagree.

    ``both`` gives each row with the side that has more copies and how many more.
    ``parity`` keeps the one-sided answer of the unparenthesised EXCEPT chain: the
    distinct expected rows that the actual table lacks.

    Most rows are alike in nothing but their twin, so summing them up before the shuffle would
    only fill a task's memory with its whole part of the table: rows are dealt by their hash first.
    """
    columns = expected.columns
    net = (
        actual.select(*columns).withColumn("_a", F.lit(1)).withColumn("_e", F.lit(0))
        .unionByName(expected.withColumn("_a", F.lit(0)).withColumn("_e", F.lit(1)))
        .withColumn("_h", F.xxhash64(*columns))
        .repartition("_h")
        .groupBy("_h", *columns)
        .agg(F.sum("_a").alias("_a"), F.sum("_e").alias("_e"))
    )
    if mode == "parity":
        return net.filter((F.col("_e") > 0) & (F.col("_a") == 0)).select(*columns)
    return net.filter(F.col("_a") != F.col("_e")).select(
        *columns,
        F.when(F.col("_a") > F.col("_e"), "actual").otherwise("expected").alias("side"),
        F.abs(F.col("_a") - F.col("_e")).cast("bigint").alias("copies"),
    )


# The tests that must fail for each fault variant.
EXPECTED_FAILURES = {
    "null-inflated": ("not_null", "parity"),
    "semantic-drift": ("parity",),
    "unmapped-value": ("accepted_values", "parity"),
}


def fault_detection(
    variants: DataFrame, key: str, legacy: str, replacement: str, accepted: Sequence[str]
) -> DataFrame:
    """Every test on every variant: failing rows, whether it had to fail, whether it did.

    The variants are written once; each test then reads only its columns.
    """
    variants = cut_lineage(variants)
    tests = ColumnTests(not_null=(replacement,), unique=(key,), accepted={replacement: tuple(accepted)})
    results = column_tests(variants, tests, by=("variant_id",)).select("variant_id", "test", "failing_rows")
    parity = variants.groupBy("variant_id").agg(
        F.lit("parity").alias("test"), count_where(differs(legacy, replacement)).alias("failing_rows")
    )
    required = F.lit(False)
    for variant, names in EXPECTED_FAILURES.items():
        required = required | ((F.col("variant_id") == variant) & F.col("test").isin(*names))
    return results.unionByName(parity).select(
        "variant_id",
        "test",
        "failing_rows",
        required.alias("must_fail"),
        (~required | (F.col("failing_rows") > 0)).alias("detected"),
    )


def table_fingerprints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Content fingerprint of every table, independent of row order."""
    result: DataFrame | None = None
    for name, df in tables.items():
        part = fingerprint(df).select(F.lit(name).alias("table_name"), "row_count", "hash_xor", "hash_sum")
        result = part if result is None else result.unionByName(part)
    return result


def twins_equal(left: Mapping[str, DataFrame], right: Mapping[str, DataFrame]) -> DataFrame:
    """Whether two generations hold the same tables with the same content."""
    a = table_fingerprints(left).select("table_name", F.struct("row_count", "hash_xor", "hash_sum").alias("_a"))
    b = table_fingerprints(right).select("table_name", F.struct("row_count", "hash_xor", "hash_sum").alias("_b"))
    return a.join(b, "table_name", "full_outer").select(
        "table_name",
        F.col("_a.row_count").alias("left_rows"),
        F.col("_b.row_count").alias("right_rows"),
        F.col("_a").eqNullSafe(F.col("_b")).alias("equal"),
    )
