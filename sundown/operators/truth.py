"""Expected decisions from labelled facts, written apart from the policy so the two can disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Dispositions as the truth labels know them.
SETTLED = ("VALIDATED", "REMOVED", "NOT_APPLICABLE")
HARMFUL = ("APPLIED", "CHANGE_PROPOSED", "DISCOVERED", "FAILED", "IDENTIFIED", "OPAQUE", "STALE")


def expected_codes(facts: DataFrame, consumers: DataFrame, inventory: DataFrame, current: DataFrame) -> DataFrame:
    """Distinct ``(scenario_id, code, harmful)`` rows."""

    def code(condition, name: str, harmful: bool):
        return F.when(condition, F.struct(F.lit(name).alias("code"), F.lit(harmful).alias("harmful")))

    count = F.coalesce(F.col("identity_match_count"), F.lit(0))

    def false_or_null(name: str):
        return ~F.col(name).eqNullSafe(F.lit(True))

    scenario = F.array_compact(
        F.array(
            code(count == 0, "IDENTITY_NOT_FOUND", False),
            code((count != 0) & (count != 1), "IDENTITY_AMBIGUOUS", False),
            code(false_or_null("replacement_compatible"), "SPEC_REPLACEMENT_INCOMPATIBLE", True),
            code(~F.col("evidence_status").eqNullSafe(F.lit("COMPLETE")), "EVIDENCE_REQUIRED_SOURCE_INCOMPLETE", False),
            code(false_or_null("pagination_complete"), "EVIDENCE_PAGINATION_FAILED", False),
            code(false_or_null("native_data_fresh"), "EVIDENCE_REQUIRED_SOURCE_INCOMPLETE", False),
            code(F.coalesce("quality_failures", F.lit(0)) > 0, "VALIDATION_RECEIPT_FAILED", True),
            code(false_or_null("reconciled"), "RECONCILIATION_REQUIRED", False),
        )
    )
    rows = facts.select("scenario_id", F.explode(scenario).alias("_c")).select("scenario_id", "_c.*")
    d = F.col("disposition")
    from_consumers = (
        consumers.filter(~d.isin(*SETTLED))
        .select(
            "scenario_id",
            F.when(d == "UNRESOLVED", "IDENTITY_NOT_FOUND")
            .when(d == "WAIVED", "POLICY_WAIVER_FORBIDDEN")
            .when(d.isin(*HARMFUL), F.concat(F.lit("POLICY_CONSUMER_"), d))
            .alias("code"),
            d.isin(*HARMFUL).alias("harmful"),
        )
        .filter("code IS NOT NULL")
    )
    key = ["scenario_id", "consumer_id"]
    late = (
        current.select(*key)
        .join(inventory.select(*key), key, "left_anti")
        .select("scenario_id", F.lit("RECONCILIATION_NEW_CONSUMER").alias("code"), F.lit(True).alias("harmful"))
    )
    return rows.unionByName(from_consumers).unionByName(late).distinct()


def expected_decisions(facts: DataFrame, consumers: DataFrame, inventory: DataFrame, current: DataFrame) -> DataFrame:
    """Expected decision and sorted distinct codes per scenario; the code list is bounded by the vocabulary."""
    per_scenario = expected_codes(facts, consumers, inventory, current).groupBy("scenario_id").agg(
        F.max("harmful").alias("harmful"), F.array_sort(F.collect_set("code")).alias("codes")
    )
    return facts.select("scenario_id").join(per_scenario, "scenario_id", "left").select(
        "scenario_id",
        F.when(F.col("harmful"), "UNSAFE")
        .when(F.col("codes").isNotNull(), "BLOCKED")
        .otherwise("READY_TO_RETIRE")
        .alias("decision"),
        F.coalesce(F.concat_ws(",", "codes"), F.lit("")).alias("codes"),
    )


def compare_decisions(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed against expected ``(scenario_id, decision, codes)``, scenario by scenario."""
    a = observed.select("scenario_id", F.col("decision").alias("observed_decision"), F.col("codes").alias("observed_codes"))
    b = expected.select("scenario_id", F.col("decision").alias("expected_decision"), F.col("codes").alias("expected_codes"))
    ready = F.lit("READY_TO_RETIRE")
    return a.join(b, "scenario_id", "full_outer").select(
        "scenario_id",
        "observed_decision",
        "observed_codes",
        "expected_decision",
        "expected_codes",
        (
            F.col("observed_decision").eqNullSafe(F.col("expected_decision"))
            & F.col("observed_codes").eqNullSafe(F.col("expected_codes"))
        ).alias("matched"),
        (F.col("observed_decision").eqNullSafe(ready) & ~F.col("expected_decision").eqNullSafe(ready)).alias("false_ready"),
    )


def comparison_summary(comparison: DataFrame) -> DataFrame:
    """Totals, and the self-check: with every expectation falsified, nothing may match."""
    ready = F.lit("READY_TO_RETIRE")
    falsified = F.when(F.col("observed_decision").eqNullSafe(ready), F.lit("UNSAFE")).otherwise(ready)
    return comparison.agg(
        F.count_if("matched").alias("matched_scenarios"),
        F.count_if(~F.col("matched")).alias("diverged_scenarios"),
        F.count_if("false_ready").alias("false_readiness"),
        (F.count_if(falsified.eqNullSafe(F.col("observed_decision"))) == 0).alias("corrupt_truth_rejected"),
    )
