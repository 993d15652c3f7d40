"""Audits of approvals, waivers, receipts, clocks, scenarios, specs and raw records.

Each audit names the first check a record fails, or null. ``digest_valid`` is the result
of checking the record's own digest; ``now`` is the trusted time of the audit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.functions.checks import differs, first_code, not_true
from sundown.functions.clock import clock_code, text_clock_checks
from sundown.functions.paths import inside_root
from sundown.operators.scans import path_allowed


def _same_set(left: str, right: str) -> Column:
    """Equal as multisets."""
    return F.array_sort(left).eqNullSafe(F.array_sort(right))


def _lacks(required: str, held: str) -> Column:
    return F.size(F.array_except(required, F.coalesce(held, F.array().cast("array<string>")))) > 0


def latest(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last recorded row per key."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def approval_audit(requests: DataFrame, approvals: DataFrame, now: Column) -> DataFrame:
    """Requests to apply a plan against the approval submitted for each; the latest approval counts."""
    given = latest(approvals, "request_id", "recorded")
    held = given.select("request_id", F.lit(True).alias("_given"), *[F.col(c).alias(f"a_{c}") for c in given.columns if c != "request_id"])
    joined = requests.join(held, "request_id", "left")
    code = first_code(
        [
            (F.col("_given").isNull(), "AUTH_APPROVAL_MISSING"),
            (not_true("a_digest_valid"), "INTEGRITY_DIGEST_MISMATCH"),
            (differs("a_campaign_id", "campaign_id"), "AUTH_APPROVAL_WRONG_CAMPAIGN"),
            (differs("a_plan_digest", "plan_digest"), "AUTH_APPROVAL_WRONG_PLAN"),
            (differs("a_source_version", "source_version"), "AUTH_APPROVAL_WRONG_SOURCE"),
            (~_same_set("a_targets", "targets"), "AUTH_APPROVAL_WRONG_SCOPE"),
            (_lacks("required_scope", "a_scope"), "AUTH_APPROVAL_WRONG_SCOPE"),
            (differs("a_authorization_digest", "authorization_digest"), "AUTH_APPROVAL_WRONG_SCOPE"),
            *text_clock_checks(
                now, "a_authorized_at", "a_expires_at", F.col("last_trusted_at"), "AUTH_APPROVAL_EXPIRED"
            ),
        ]
    )
    return joined.select("request_id", "campaign_id", code.alias("refusal_code"))


def waiver_audit(waivers: DataFrame, now: Column) -> DataFrame:
    """Waivers, each next to the campaign, consumer and scope it is used for (``used_*``)."""
    code = first_code(
        [
            (not_true("digest_valid"), "INTEGRITY_DIGEST_MISMATCH"),
            (
                differs("campaign_id", "used_campaign_id") | differs("consumer_id", "used_consumer_id")
                | _lacks("used_scope", "scope"),
                "AUTH_WAIVER_INVALID",
            ),
            *text_clock_checks(now, "authorized_at", "expires_at", expired_code="AUTH_WAIVER_EXPIRED"),
        ]
    )
    return waivers.select("waiver_id", code.alias("refusal_code"))


def receipt_audit(receipts: DataFrame, consumers: DataFrame, now: Column, require_live: bool = True) -> DataFrame:
    """Receipts against the consumer they were submitted for (``receipt_id`` joins them)."""
    expected = consumers.select("receipt_id", *[F.col(c).alias(f"x_{c}") for c in (
        "campaign_id", "consumer_id", "plan_digest", "source_version", "approved_targets")])
    joined = receipts.join(expected, "receipt_id", "left")
    code = first_code(
        [
            (not_true("digest_valid"), "INTEGRITY_DIGEST_MISMATCH"),
            (differs("campaign_id", "x_campaign_id") | differs("consumer_id", "x_consumer_id"), "IDENTITY_NOT_FOUND"),
            (F.lit(require_live) & differs("mode", F.lit("live")), "EVIDENCE_RECEIPT_MODE_NOT_LIVE"),
            (differs("plan_digest", "x_plan_digest"), "AUTH_APPROVAL_WRONG_PLAN"),
            (
                ~_same_set("approved_targets", "x_approved_targets")
                | ~_same_set("proposed_targets", "x_approved_targets")
                | ~_same_set("actual_targets", "x_approved_targets"),
                "SCOPE_RECEIPT_TARGET_MISMATCH",
            ),
            (differs("source_version", "x_source_version"), "SOURCE_RECEIPT_VERSION_MISMATCH"),
            (F.col("result").eqNullSafe(F.lit("FAILED")), "VALIDATION_RECEIPT_FAILED"),
            (differs("result", F.lit("PASSED")), "VALIDATION_RECEIPT_INCONCLUSIVE"),
            (differs("terminal_disposition", F.lit("VALIDATED")), "VALIDATION_RECEIPT_FAILED"),
            *text_clock_checks(now, "captured_at", "expires_at"),
        ]
    )
    return joined.select("receipt_id", "campaign_id", code.alias("refusal_code"))


def clock_audit(df: DataFrame, now: Column) -> DataFrame:
    """Rows with text columns observed_at, last_trusted_at, source_clock_at, expires_at."""
    code = clock_code(now, F.col("observed_at"), F.col("last_trusted_at"), F.col("source_clock_at"), F.col("expires_at"))
    return df.select("record_id", code.alias("refusal_code"))


def scenario_precheck(scenarios: DataFrame, files: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """First refusal of each scenario before anything is planned.

    ``scenarios``: scenario_id, evidence_required, evidence_status, identity_match_count,
    replacement_compatible, source_path, expected_fingerprint. ``files``: path, fingerprint.
    """
    placed = scenarios.withColumn("_path", inside_root(F.col("source_path")))
    known = files.select(F.col("path").alias("_path"), F.col("fingerprint").alias("_actual"))
    code = first_code(
        [
            (F.col("evidence_required") & differs("evidence_status", F.lit("COMPLETE")), "EVIDENCE_REQUIRED_SOURCE_INCOMPLETE"),
            (F.col("identity_match_count") == 0, "IDENTITY_NOT_FOUND"),
            (F.col("identity_match_count") != 1, "IDENTITY_AMBIGUOUS"),
            (not_true("replacement_compatible"), "SPEC_REPLACEMENT_INCOMPATIBLE"),
            (F.col("_path").isNull(), "SCOPE_PATH_OUTSIDE_ROOT"),
            (F.col("_actual").isNull(), "SOURCE_NOT_FOUND"),
            (~path_allowed(F.col("source_path"), allowed), "SCOPE_TARGET_NOT_ALLOWED"),
            (differs("_actual", "expected_fingerprint"), "SOURCE_FINGERPRINT_MISMATCH"),
        ]
    )
    return placed.join(known, "_path", "left").select("scenario_id", code.alias("refusal_code"))


# The parts that name a table.
TABLE_PARTS = ("platform", "instance", "database", "schema", "table")


def spec_audit(specs: DataFrame) -> DataFrame:
    """Specs with structs ``target`` and ``replacement``: same field, or another table, listing the changed parts."""
    changed = F.array_compact(F.array(*[
        F.when(differs(f"target.{p}", f"replacement.{p}"), F.lit(p)) for p in TABLE_PARTS]))
    same_field = F.col("target.field").eqNullSafe(F.col("replacement.field"))
    code = first_code(
        [
            ((F.size(changed) == 0) & same_field, "SPEC_IDENTICAL_FIELDS"),
            (F.size(changed) > 0, "SPEC_UNSUPPORTED_REPLACEMENT"),
        ]
    )
    return specs.select("spec_id", code.alias("refusal_code"), F.concat_ws(",", changed).alias("changed_parts"))


@dataclass(frozen=True)
class FieldRule:
    """One field of a record contract."""

    name: str
    kind: str = "string"
    required: bool = True
    allowed: tuple[str, ...] = ()
    pattern: str | None = None
    low: float | None = None
    high: float | None = None


def contract_audit(records: DataFrame, raw: str, rules: Sequence[FieldRule]) -> DataFrame:
    """Violations of each JSON record: how many, and the first in the order of the contract."""
    keys = F.json_object_keys(raw)
    parsed = F.from_json(raw, ", ".join(f"`{r.name}` string" for r in rules))
    found: list[Column] = [F.when(keys.isNull(), F.lit("NOT_AN_OBJECT"))]
    for rule in rules:
        value = F.col("_v")[rule.name]

        def broken(condition: Column, what: str) -> Column:
            return F.when(F.coalesce(condition, F.lit(False)), F.lit(f"{what}:{rule.name}"))

        if rule.required:
            found.append(broken(keys.isNotNull() & value.isNull(), "MISSING"))
        if rule.kind != "string":
            found.append(broken(value.isNotNull() & value.try_cast(rule.kind).isNull(), "TYPE"))
        if rule.allowed:
            found.append(broken(~value.isin(*rule.allowed), "ENUM"))
        if rule.pattern:
            found.append(broken(~value.rlike(rule.pattern), "PATTERN"))
        number = value.try_cast("double")
        if rule.low is not None:
            found.append(broken(number < rule.low, "RANGE"))
        if rule.high is not None:
            found.append(broken(number > rule.high, "RANGE"))
    unknown = F.array_except(keys, F.array(*[F.lit(r.name) for r in rules]))
    found.append(F.when(F.size(unknown) > 0, F.concat(F.lit("UNKNOWN:"), F.concat_ws(",", F.array_sort(unknown)))))
    violations = F.array_compact(F.array(*found))
    return records.withColumn("_v", parsed).select(
        *[c for c in records.columns if c != raw],
        F.size(violations).cast("bigint").alias("violations"),
        F.try_element_at(violations, F.lit(1)).alias("first_violation"),
    )

