"""Manifests and reports: what each campaign's state means for its owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.functions.checks import count_where, differs
from sundown.functions.hashing import digest, row_number_hash
from sundown.functions.ordered import range_row_numbers
from sundown.functions.text import public_text
from sundown.operators import events as ev
from sundown.operators import policy as p
from sundown.vocabulary import CLOSED_DISPOSITIONS

# Next action per decision, and the one before publication.
NEXT_ACTION = {
    "READY_TO_RETIRE": "Prepare one short-lived producer plan and run the gate immediately before the producer change.",
    "REVIEW_REQUIRED": "Resolve the recorded review requirement, preserve any residual risk, then reconcile and evaluate again.",
    "BLOCKED": "Resolve the blocking evidence or authorization, then resume at the step named below.",
    "UNSAFE": "Migrate or resolve every unsafe consumer, validate in its native system, then reconcile again.",
}
PUBLISH_FIRST = "Publish and verify the campaign summary, then prepare one short-lived producer plan and run the gate."
UNKNOWN_ACTION = "Stop and inspect the canonical campaign state."

# Family of a code, its evidence source and recovery action.
RECOVERY = {
    "EVIDENCE": ("evidence envelope", "Refresh or restore the required source, verify complete pagination and freshness, then inventory or reconcile again."),
    "IDENTITY": ("native identity mapping", "Resolve exactly one native object for the consumer before planning a change."),
    "AUTH": ("authorization record", "Review the exact plan and record a fresh, target-bound authorization."),
    "SOURCE": ("source-native precondition", "Reread the source, preserve any intervening owner change, and create a new plan from current state."),
    "SCOPE": ("authorized target scope", "Reduce the proposed change to the exact allowlist and authorize a new plan."),
    "APPLY": ("native apply result", "Discover the actual native state before retrying or compensating."),
    "VALIDATION": ("source-native validator", "Fix the native validation failure and obtain a new passing receipt."),
    "COMPENSATION": ("source-native recovery", "Resolve the recovery conflict in the source system without overwriting an intervening owner change."),
    "RECONCILIATION": ("fresh reconciliation", "Refresh equivalent evidence scope and reconcile the complete observed set again."),
    "POLICY": ("campaign policy", "Resolve the named consumer state or policy input, then evaluate again."),
    "INTEGRITY": ("campaign integrity check", "Stop mutation, restore the canonical artifact or event stream, and reverify it."),
    "RUNTIME": ("campaign runtime", "Restore the named local runtime boundary, then resume from durable state."),
    "GATE": ("producer-side gate", "Do not retire the field; repair the named gate precondition and issue a new short-lived plan."),
}
DEFAULT_RECOVERY = ("canonical campaign state", "Inspect the canonical event history and resolve this condition before continuing.")

# Labels of a consumer's receipt.
RECEIPT_LABELS = {
    "STALE": "STALE — recorded receipt is not acceptable now",
    "VALIDATED": "VALIDATED — native receipt accepted at manifest time",
    "RECORDED": "RECORDED — receipt does not close the current state",
    "MISSING": "MISSING — no accepted native validation receipt",
}


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    """A fixed small table as a map literal, so no join is needed."""
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def event_policy_inputs(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """State, sources, consumers and late consumers of every campaign, folded from the log."""
    state = ev.campaign_state(log)
    campaigns = state.select(
        "campaign_id", F.col("envelope.mode").alias("mode"), "reconciled", F.lit(True).alias("inputs_match"), "policy")
    sources = state.select("campaign_id", F.explode("envelope.sources").alias("s")).select(
        "campaign_id", F.col("s.id").alias("source_id"), "s.required", "s.status")
    annotated = ev.annotate(log)
    return state, campaigns, sources, ev.consumer_state(annotated), ev.new_consumer_state(annotated)


def manifest(log: DataFrame, policy: p.AnyPolicy = p.CampaignPolicy()) -> DataFrame:
    """One row per campaign: state, decision, sizes and a digest of the consumer set.

    Each campaign is judged by the policy of its creating event unless one is given for all.

    The consumers, blockers and history themselves stay rows
    (:func:`manifest_entries`), because a campaign may have any number of them.
    """
    state, campaigns, sources, consumers, added = event_policy_inputs(log)
    facts = p.campaign_facts(campaigns, sources, consumers, added)
    decided = p.decide(facts, policy)
    per_set = (
        consumers.withColumn("h", row_number_hash(["consumer_id", "disposition", "receipt_digest"]))
        .groupBy("campaign_id")
        .agg(
            F.count(F.lit(1)).alias("consumers"),
            F.count_if(F.col("disposition").isin(*CLOSED_DISPOSITIONS)).alias("closed"),
            F.bit_xor("h").alias("consumer_hash"),
        )
    )
    zero = F.lit(0).cast("bigint")
    head = state.join(decided, "campaign_id", "left").join(per_set, "campaign_id", "left").select(
        "campaign_id", "state", "decision", "events", "snapshots", "receipts", "blockers", "reviews", "last_event_at", "head_digest",
        F.coalesce("consumers", zero).alias("consumers"),
        F.coalesce("closed", zero).alias("closed"),
        F.coalesce("consumer_hash", zero).alias("consumer_hash"),
        F.col("envelope.mode").alias("evidence_mode"),
        digest(F.coalesce(F.to_json("envelope"), F.lit("{}"))).alias("envelope_digest"),
    )
    return head.withColumn("manifest_digest", digest(F.concat_ws(
        "|", "campaign_id", "state", "decision", "head_digest", "consumer_hash", "envelope_digest")))


def manifest_entries(log: DataFrame, policy: p.AnyPolicy = p.CampaignPolicy()) -> DataFrame:
    """The repeated parts of the manifest as rows ``(campaign_id, section, entry, value)``."""
    _, campaigns, sources, consumers, added = event_policy_inputs(log)
    facts = p.campaign_facts(campaigns, sources, consumers, added)
    blockers = p.blocker_rows(facts, sources, consumers, added, policy=policy)
    return (
        consumers.select("campaign_id", F.lit("consumer").alias("section"), F.col("consumer_id").alias("entry"), F.col("disposition").alias("value"))
        .unionByName(blockers.select("campaign_id", F.lit("blocker").alias("section"),
                                     F.coalesce("consumer_id", "source_id", F.lit("")).alias("entry"), F.col("code").alias("value")))
        .unionByName(log.select("campaign_id", F.lit("history").alias("section"), F.col("sequence").cast("string").alias("entry"),
                                F.col("event_type").alias("value")))
    )


def campaign_rollup(decisions: DataFrame, consumers: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """Counts and next action per campaign. ``consumers`` carry disposition and receipt_digest."""
    counted = consumers.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("consumers"),
        F.count_if(F.col("disposition").isin(*CLOSED_DISPOSITIONS)).alias("closed"),
        F.count_if(F.col("receipt_digest").isNotNull()).alias("receipts"),
    )
    zero = F.lit(0).cast("bigint")
    joined = decisions.join(counted, "campaign_id", "left")
    verified = F.lit(False)
    if published is not None:
        joined = joined.join(published.select("campaign_id", F.lit(True).alias("_published")).distinct(), "campaign_id", "left")
        verified = F.coalesce("_published", F.lit(False))
    action = F.when((F.col("decision") == "READY_TO_RETIRE") & ~verified, F.lit(PUBLISH_FIRST)).otherwise(
        _lookup(NEXT_ACTION, F.col("decision"), UNKNOWN_ACTION))
    return joined.select(
        "campaign_id", "decision",
        F.coalesce("consumers", zero).alias("consumers"),
        F.coalesce("closed", zero).alias("closed"),
        (F.coalesce("consumers", zero) - F.coalesce("closed", zero)).alias("open"),
        "blockers", "reviews", (F.col("blockers") + F.col("reviews")).alias("conditions"),
        F.coalesce("receipts", zero).alias("receipts"),
        action.alias("next_action"),
    )


def receipt_label(state: Column) -> Column:
    return _lookup(RECEIPT_LABELS, state, RECEIPT_LABELS["MISSING"])


def receipt_state(disposition: Column, receipt: Column) -> Column:
    """STALE, VALIDATED, RECORDED or MISSING."""
    return (
        F.when(disposition == "STALE", "STALE")
        .when((disposition == "VALIDATED") & receipt.isNotNull(), "VALIDATED")
        .when(receipt.isNotNull(), "RECORDED")
        .otherwise("MISSING")
    )


def source_coverage(campaigns: DataFrame, sources: DataFrame) -> DataFrame:
    """UNKNOWN, INCOMPLETE, NON_LIVE or BOUNDED_COMPLETE per campaign, with the counts behind it."""
    counted = sources.groupBy("campaign_id").agg(
        F.count_if("required").alias("required"),
        F.count_if(F.col("required") & F.col("status").eqNullSafe(F.lit("COMPLETE"))).alias("complete"),
    )
    zero = F.lit(0).cast("bigint")
    return campaigns.join(counted, "campaign_id", "left").withColumn("required", F.coalesce("required", zero)).withColumn(
        "complete", F.coalesce("complete", zero)
    ).select(
        "campaign_id",
        F.when(F.col("required") == 0, "UNKNOWN")
        .when(F.col("complete") < F.col("required"), "INCOMPLETE")
        .when(differs("mode", F.lit("live")), "NON_LIVE")
        .otherwise("BOUNDED_COMPLETE")
        .alias("coverage"),
        "required", "complete", (F.col("required") - F.col("complete")).alias("gaps"),
    )


def explain_blockers(blockers: DataFrame) -> DataFrame:
    """Where the evidence of each code lives and how to recover, by the family before the first underscore."""
    family = F.when(F.instr("code", "_") > 0, F.split("code", "_")[0]).otherwise(F.lit(""))
    return blockers.withColumn(
        "evidence_source", _lookup({k: v[0] for k, v in RECOVERY.items()}, family, DEFAULT_RECOVERY[0])
    ).withColumn("recovery_action", _lookup({k: v[1] for k, v in RECOVERY.items()}, family, DEFAULT_RECOVERY[1]))


def operational_metrics(
    log: DataFrame, attempts: DataFrame, claims: DataFrame, now: Column, stuck_after_seconds: int
) -> DataFrame:
    """Counts by kind and the alerts, as ``(metric, label, value)`` rows.

    ``attempts``: status, refusal_code. ``claims``: released_at. Every input is read once and gives
    each row's entries, which are summed up together, map-side first.
    """
    if stuck_after_seconds < 1:
        raise ValueError("the stuck threshold must be positive")
    age = F.unix_seconds(now) - F.unix_seconds("last_event_at")
    stuck = ~F.col("state").isin("BLOCKED", "READY", "RETIRED") & (age > stuck_after_seconds)
    stale = F.exists("envelope.sources", lambda s: s["status"].isin("STALE", "PARTIAL", "UNAVAILABLE", "UNKNOWN"))

    def entry(metric: str, label: Column, counts: Column | None = None) -> Column:
        n = F.lit(1) if counts is None else F.when(counts, F.lit(1)).otherwise(F.lit(0))
        return F.struct(F.lit(metric).alias("metric"), label.alias("label"), n.cast("bigint").alias("n"))

    def entries(df: DataFrame, *items: Column) -> DataFrame:
        return df.select(F.explode(F.array_compact(F.array(*items))).alias("e")).select("e.*")

    none, refusal = F.lit(""), F.col("refusal_code")
    totals = ("stuck_campaigns", "stale_campaigns", "unknown_outcomes", "pending_intents", "active_claims")
    rows = (
        entries(log.sparkSession.range(1), *[entry(metric, none, F.lit(False)) for metric in totals])
        .unionByName(entries(
            ev.campaign_state(log), entry("campaign_state", F.col("state")), entry("stuck_campaigns", none, stuck),
            entry("stale_campaigns", none, stale)))
        .unionByName(entries(log, entry("event_type", F.col("event_type"))))
        .unionByName(entries(
            attempts, entry("gate_status", F.col("status")), F.when(refusal.isNotNull(), entry("gate_refusal", refusal)),
            entry("unknown_outcomes", none, F.col("status") == "OUTCOME_UNKNOWN"),
            entry("pending_intents", none, F.col("status") == "INTENT_RECORDED")))
        .unionByName(entries(claims, entry("active_claims", none, F.col("released_at").isNull())))
    )
    summed = rows.groupBy("metric", "label").agg(F.sum("n").alias("value"))
    repeated = (F.col("metric") == "gate_refusal") & (F.col("value") >= 3)
    both = F.array_compact(F.array(F.col("metric"), F.when(repeated, F.lit("repeated_refusal"))))
    return summed.select(F.explode(both).alias("metric"), "label", "value")


# Metrics that make the whole unhealthy when above zero.
ALERTS = ("stuck_campaigns", "stale_campaigns", "repeated_refusal", "unknown_outcomes", "pending_intents")


def health(metrics: DataFrame) -> DataFrame:
    alerting = F.col("metric").isin(*ALERTS) & (F.col("value") > 0)
    return metrics.agg((~F.coalesce(F.max(alerting), F.lit(False))).alias("healthy"), count_where(alerting).alias("alerts"))


def stuck_campaigns(log: DataFrame, now: Column, stuck_after_seconds: int) -> DataFrame:
    """Campaigns waiting longer than the threshold, named only by the digest of their id."""
    age = F.unix_seconds(now) - F.unix_seconds("last_event_at")
    return ev.campaign_state(log).filter(
        ~F.col("state").isin("BLOCKED", "READY", "RETIRED") & (age > stuck_after_seconds)
    ).select(digest(F.concat(F.lit('"'), "campaign_id", F.lit('"'))).alias("campaign_id_digest"), "state", age.alias("age_seconds"))


def public_consumers(consumers: DataFrame) -> DataFrame:
    """Consumers under positional labels, in the order of their withheld ids."""
    numbered = range_row_numbers(consumers, ["campaign_id"], ["consumer_id"])
    wide = F.when(F.col("position") < 1000, F.lpad(F.col("position").cast("string"), 3, "0")).otherwise(F.col("position").cast("string"))
    return numbered.select(
        "campaign_id", F.concat(F.lit("consumer-"), wide).alias("label"), "disposition",
        F.col("disposition").isin(*CLOSED_DISPOSITIONS).alias("closed"),
        receipt_label(receipt_state(F.col("disposition"), F.col("receipt_digest"))).alias("receipt_state"),
    )


def public_sources(sources: DataFrame) -> DataFrame:
    """Sources under positional labels with guarded limitation texts."""
    numbered = range_row_numbers(sources, ["campaign_id"], ["source_id"])
    return numbered.select(
        "campaign_id", F.concat(F.lit("declared-source-"), F.col("position").cast("string")).alias("label"),
        "required", F.coalesce("status", F.lit("UNKNOWN")).alias("status"),
        public_text(F.col("limitation"), "A source limitation is recorded in the private manifest.").alias("limitation"),
    )


# Fixed value: the bound every published decision carries.
SCOPE_STATEMENT = (
    "This decision is bounded by the recorded evidence envelope and does not claim universal safety."
)


def campaign_summary(manifests: DataFrame) -> DataFrame:
    """Only what may be published about each campaign."""
    return manifests.select(
        "campaign_id", "decision", "blockers", F.col("envelope_digest").alias("evidence_envelope_digest"), "manifest_digest",
        F.lit(SCOPE_STATEMENT).alias("scope_statement"),
    )
