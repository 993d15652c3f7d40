"""Reconciliation of fresh evidence with the frozen baseline, and readiness of the producer gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.functions.checks import differs, first_code, not_true
from sundown.functions.clock import clock_checks
from sundown.functions.ordered import sliced_before
from sundown.vocabulary import PLAN_LIFETIME_SECONDS

# What makes two scopes the same; totals, pages and times do not count.
SCOPE_COLUMNS = ("required", "identity", "direction", "max_hops", "filters", "principal", "effective_scope")


def scope_equivalence(campaigns: DataFrame, baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Whether both captures declare the same sources with the same scope; filter order counts."""
    key = ["campaign_id", "source_id"]
    a = baseline.select(*key, F.struct(*SCOPE_COLUMNS).alias("_a"))
    b = current.select(*key, F.struct(*SCOPE_COLUMNS).alias("_b"))
    different = a.join(b, key, "full_outer").filter(differs("_a", "_b")).groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("different_sources"))
    return campaigns.select("campaign_id").join(different, "campaign_id", "left").select(
        "campaign_id",
        F.coalesce("different_sources", F.lit(0)).cast("bigint").alias("different_sources"),
        F.when(F.col("different_sources") > 0, F.lit("RECONCILIATION_SCOPE_MISMATCH")).alias("refusal_code"),
    )


def invalidate_consumers(consumers: DataFrame, drift: DataFrame) -> DataFrame:
    """VALIDATED consumers whose source drifted become STALE; every other disposition stays."""
    key = ["campaign_id", "consumer_id"]
    hit = drift.select(*key).distinct().withColumn("_d", F.lit(True))
    stale = F.col("_d").isNotNull() & (F.col("disposition") == "VALIDATED")
    return consumers.join(hit, key, "left").withColumn(
        "disposition", F.when(stale, F.lit("STALE")).otherwise(F.col("disposition"))
    ).drop("_d")


def invalidate_sources(sources: DataFrame, drift: DataFrame, limitation: str) -> DataFrame:
    """Drifted sources become STALE and say why."""
    key = ["campaign_id", "source_id"]
    hit = drift.select(*key).distinct().withColumn("_d", F.lit(True))
    gone = F.col("_d").isNotNull()
    return sources.join(hit, key, "left").withColumn(
        "status", F.when(gone, F.lit("STALE")).otherwise(F.col("status"))
    ).withColumn(
        "limitations",
        F.when(gone, F.array_sort(F.array_union("limitations", F.array(F.lit(limitation))))).otherwise(F.col("limitations")),
    ).drop("_d")


def refresh_status(refreshes: DataFrame, observations: DataFrame) -> DataFrame:
    """First observation of each requested refresh before its deadline, or a timeout.

    ``refreshes``: refresh_id, urn, requested_at, deadline. ``observations``: urn,
    source_updated_at, observed_at. An observation counts for a refresh if its source was updated
    after the request; the earliest of these decides, for if it comes too late, all do. So both are
    put in one sequence per URN by those times, and each refresh takes the least observation time
    of the rows after it. Slices of the sequence hold a bounded number of rows, whatever their
    keys, so nothing is multiplied and a URN with very many of both is worked on by many tasks.
    """
    none = F.lit(None)
    asked = refreshes.select(
        "urn", F.col("requested_at").alias("at"), F.lit(1).alias("tie"), none.cast("timestamp").alias("seen"), "refresh_id", "deadline",
        F.lit(True).alias("asked"))
    seen = observations.select(
        "urn", F.col("source_updated_at").alias("at"), F.lit(0).alias("tie"), F.col("observed_at").alias("seen"),
        none.cast(refreshes.schema["refresh_id"].dataType).alias("refresh_id"), none.cast("timestamp").alias("deadline"), F.lit(False).alias("asked"))
    # Backwards in time, a refresh after the observations of its own instant.
    rows = asked.unionByName(seen.filter("at IS NOT NULL")).withColumn("back", -F.unix_micros("at"))
    placed = sliced_before(rows, ["urn"], ["back", "tie"], least={"first_seen": F.col("seen")})
    hit = F.when(F.col("first_seen") <= F.col("deadline"), F.col("first_seen"))
    return placed.filter("asked").select(
        "refresh_id",
        "urn",
        hit.alias("observed_at"),
        F.when(hit.isNull(), F.lit("RECONCILIATION_REFRESH_TIMEOUT")).alias("refusal_code"),
    )


def plan_window_checks(now: Column, prepared: Column, expires: Column) -> list[tuple[Column, str]]:
    too_long = F.unix_micros(expires) - F.unix_micros(prepared) > PLAN_LIFETIME_SECONDS * 1_000_000
    return [
        (F.coalesce(too_long, F.lit(False)), "GATE_PLAN_INVALID"),
        (prepared.isNull() | expires.isNull(), "RUNTIME_CLOCK_INVALID"),
        *clock_checks(now, observed=prepared, expires=expires, expired_code="GATE_PLAN_EXPIRED"),
    ]


def plan_window(plans: DataFrame, now: Column) -> DataFrame:
    """Plans that live too long, come from the future, or have expired."""
    return plans.select(
        "plan_digest", first_code(plan_window_checks(now, F.col("prepared_at"), F.col("expires_at"))).alias("refusal_code"))


# Attempts in these states consume their plan.
CONSUMING = ("INTENT_RECORDED", "EXECUTED", "OUTCOME_UNKNOWN")


def ledger_audit(attempts: DataFrame) -> DataFrame:
    """Consuming attempts: only the first per plan and per (campaign, manifest) may stand."""
    consuming = attempts.filter(F.col("status").isin(*CONSUMING))
    spot = F.struct("recorded_at", "attempt_id")
    by_plan = consuming.groupBy("plan_digest").agg(F.min(spot).alias("_p"))
    by_manifest = consuming.groupBy("campaign_id", "manifest_digest").agg(F.min(spot).alias("_m"))
    first = (F.col("_p") == spot) & (F.col("_m") == spot)
    return consuming.join(by_plan, "plan_digest").join(by_manifest, ["campaign_id", "manifest_digest"]).select(
        "attempt_id", "campaign_id", "plan_digest", "status",
        F.when(~first, F.lit("GATE_PLAN_REPLAYED")).alias("refusal_code"),
    )


def source_gate_checks(now: Column) -> list[tuple[Column, str]]:
    observed, updated = F.col("observed_at"), F.col("source_updated_at")
    age = F.unix_micros(now) - F.unix_micros(updated)
    return [
        (differs("status", F.lit("COMPLETE")), "EVIDENCE_REQUIRED_SOURCE_INCOMPLETE"),
        (observed.isNull(), "RUNTIME_CLOCK_INVALID"),
        *clock_checks(now, observed=observed),
        # At the gate an unknown update time is an error, not a limitation.
        (updated.isNull(), "RUNTIME_CLOCK_INVALID"),
        *clock_checks(now, observed=updated),
        (age > F.col("maximum_age_seconds").cast("bigint") * 1_000_000, "EVIDENCE_REQUIRED_SOURCE_INCOMPLETE"),
    ]


def gate_freshness(sources: DataFrame, now: Column) -> DataFrame:
    """The first required source of each campaign, by id, that is not complete and fresh; others are absent."""
    failing = sources.filter("required").withColumn("refusal_code", first_code(source_gate_checks(now))).filter(
        "refusal_code IS NOT NULL")
    return failing.groupBy("campaign_id").agg(F.min(F.struct("source_id", "refusal_code")).alias("_f")).select(
        "campaign_id", "_f.source_id", "_f.refusal_code")


def receipt_type_audit(receipts: DataFrame, configured: Sequence[str]) -> DataFrame:
    """Accepted receipts whose validator type is no longer configured."""
    # Fixed value: the one adapter whose receipt type has another name.
    kind = F.when(F.col("adapter") == "git-dbt", F.lit("dbt")).otherwise(F.col("adapter"))
    known = F.coalesce(kind.isin(*configured), F.lit(False))
    return receipts.filter(~known).select("campaign_id", F.lit("POLICY_INPUT_DRIFT").alias("refusal_code"))


def bound_snapshots(plans: DataFrame, snapshots: DataFrame, now: Column) -> DataFrame:
    """Each source as its campaign's plan was bound to it and as it is at the gate.

    ``plans``: campaign_id, plan_digest, prepared_at. ``snapshots``: campaign_id, source_id, role
    (``source`` or ``binding``), observed_at, snapshot_id, fingerprint. Two as-of selections, the last
    snapshot at preparation and the last one now, as one aggregation: a plan meets its campaign's
    snapshots by equality, and a campaign with very many of them is reduced map-side. A source that
    appeared or was never seen before preparation differs.
    """
    spot = F.struct("observed_at", "snapshot_id")
    at_plan = F.col("observed_at") <= F.col("prepared_at")
    joined = plans.select("campaign_id", "plan_digest", "prepared_at").join(snapshots, "campaign_id").filter(F.col("observed_at") <= now)
    code = F.when(F.col("role") == "binding", F.lit("GATE_STATE_DRIFT")).otherwise(F.lit("GATE_SOURCE_DRIFT"))
    return (
        joined.groupBy("campaign_id", "plan_digest", "source_id", "role")
        .agg(F.max_by("fingerprint", F.when(at_plan, spot)).alias("bound_fingerprint"), F.max_by("fingerprint", spot).alias("fingerprint"))
        .withColumn("refusal_code", F.when(differs("bound_fingerprint", "fingerprint"), code))
    )


def consumed_plans(campaigns: DataFrame, plans: DataFrame, attempts: DataFrame) -> DataFrame:
    """Campaigns whose plan, or whose present manifest, an earlier attempt has consumed."""
    consuming = attempts.filter(F.col("status").isin(*CONSUMING))
    by_plan = plans.select("campaign_id", "plan_digest").join(consuming.select("plan_digest"), "plan_digest", "left_semi").select("campaign_id")
    key = ["campaign_id", "manifest_digest"]
    by_manifest = campaigns.select(*key).join(consuming.select(*key), key, "left_semi").select("campaign_id")
    return by_plan.unionByName(by_manifest).distinct().withColumn("refusal_code", F.lit("GATE_PLAN_REPLAYED"))


# Fixed value: the order in which the gate looks.
GATE_STEPS = (
    "ready", "plan", "provenance", "window", "binding", "inputs", "receipt types", "receipts", "approvals", "bindings", "scope", "membership",
    "freshness", "publication", "manifest", "source", "consumed",
)


def gate_readiness(
    campaigns: DataFrame, plans: DataFrame, findings: Sequence[tuple[str, DataFrame]], now: Column
) -> DataFrame:
    """First failing step of the gate for every campaign; null where the gate would open.

    ``campaigns``: campaign_id, state, decision, manifest_digest, publication_verified.
    ``plans``: campaign_id, plan_digest, issued, trusted, bound, plan_manifest_digest,
    prepared_at, expires_at. ``findings`` are audits ``(step, rows with campaign_id and
    refusal_code)`` in any order; they are reduced to one row per campaign before they meet
    the campaigns, and every check takes its place from :data:`GATE_STEPS`.
    """
    joined = campaigns.join(plans, "campaign_id", "left")
    own = [
        ("ready", differs("state", F.lit("READY")) | differs("decision", F.lit("READY_TO_RETIRE")), "GATE_DECISION_NOT_READY"),
        ("plan", not_true("issued"), "GATE_PLAN_MISSING"),
        ("provenance", not_true("trusted"), "GATE_PROVENANCE_UNTRUSTED"),
        *[("window", c, code) for c, code in plan_window_checks(now, F.col("prepared_at"), F.col("expires_at"))],
        ("binding", not_true("bound"), "GATE_PROVENANCE_UNTRUSTED"),
        ("publication", not_true("publication_verified"), "GATE_PUBLICATION_UNVERIFIED"),
        ("manifest", differs("plan_manifest_digest", "manifest_digest"), "GATE_STATE_DRIFT"),
    ]

    def place(step: str, within: int, code: Column) -> Column:
        return F.struct(F.lit(GATE_STEPS.index(step)).alias("n"), F.lit(within).alias("i"), F.lit(step).alias("step"), code.alias("code"))

    # Checks of one step keep their order, here that of the list.
    failed = [F.when(condition, place(step, i, F.lit(code))) for i, (step, condition, code) in enumerate(own)]
    rows: DataFrame | None = None
    for step, found in findings:
        part = found.filter("refusal_code IS NOT NULL").select("campaign_id", place(step, 0, F.col("refusal_code")).alias("f"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is not None:
        joined = joined.join(rows.groupBy("campaign_id").agg(F.min("f").alias("_later")), "campaign_id", "left")
        failed.append(F.col("_later"))
    return joined.withColumn("_first", F.array_min(F.array_compact(F.array(*failed)))).select(
        "campaign_id", F.col("_first.step").alias("failed_step"), F.col("_first.code").alias("refusal_code"))
