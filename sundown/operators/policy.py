"""Campaign policy: blockers and one decision per campaign, for all campaigns at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.functions.checks import count_where, differs, not_true
from sundown.vocabulary import CLOSED_DISPOSITIONS, DISPOSITIONS, OPEN_DISPOSITIONS


@dataclass(frozen=True)
class Policy:
    """One policy for all campaigns."""

    requires_live_evidence: bool = True
    require_reconciliation: bool = True
    allow_waivers: bool = False
    waivers_satisfy_closure: bool = False

    def flag(self, name: str) -> Column:
        return F.lit(getattr(self, name))


@dataclass(frozen=True)
class CampaignPolicy:
    """The policy each campaign carries in its column ``policy``, a struct of flags; what it leaves out is as in ``default``."""

    default: Policy = Policy()

    def flag(self, name: str) -> Column:
        return F.coalesce(F.col(f"policy.{name}"), self.default.flag(name))


AnyPolicy = Policy | CampaignPolicy


def _waivers(policy: AnyPolicy) -> tuple[Column, Column]:
    """Whether a waiver blocks, and whether it asks for a review."""
    allowed = policy.flag("allow_waivers")
    return ~allowed, allowed & ~policy.flag("waivers_satisfy_closure")


# Severities, the highest of a campaign gives its decision.
UNSAFE, BLOCKED, REVIEW = 3, 2, 1


def new_consumers(inventory: DataFrame, current: DataFrame) -> DataFrame:
    """Consumers observed now that the frozen inventory does not hold."""
    key = ["campaign_id", "consumer_id"]
    return current.select(*key).distinct().join(inventory.select(*key), key, "left_anti")


def _disposition_sums() -> list[Column]:
    d = F.col("disposition")
    return [
        F.count(F.lit(1)).alias("consumers"),
        F.count_if(d.isin(*CLOSED_DISPOSITIONS)).alias("closed"),
        F.count_if(d == "WAIVED").alias("waived"),
        F.count_if(d == "UNRESOLVED").alias("unresolved"),
        F.count_if(d.isin(*OPEN_DISPOSITIONS)).alias("unsafe"),
        F.count_if(not_true(d.isin(*DISPOSITIONS))).alias("unknown"),
    ]


def campaign_facts(
    campaigns: DataFrame, sources: DataFrame, consumers: DataFrame, added: DataFrame, reviews: DataFrame | None = None
) -> DataFrame:
    """Everything the policy looks at, one row per campaign, starting from the campaigns.

    Each input is counted per campaign before it is joined, so a campaign with very
    many consumers is one row by then, and a campaign without any row still appears.
    """
    per_source = sources.groupBy("campaign_id").agg(
        F.count_if("required").alias("required_sources"),
        F.count_if(F.col("required") & differs(F.col("status"), F.lit("COMPLETE"))).alias("incomplete_sources"),
    )
    per_consumer = consumers.groupBy("campaign_id").agg(*_disposition_sums())
    per_added = added.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("added"))
    facts = (
        campaigns.select("campaign_id", "mode", "reconciled", "inputs_match", *(["policy"] if "policy" in campaigns.columns else []))
        .join(per_source, "campaign_id", "left")
        .join(per_consumer, "campaign_id", "left")
        .join(per_added, "campaign_id", "left")
    )
    if reviews is None:
        facts = facts.withColumn("reviews", F.lit(0).cast("bigint"))
    else:
        per_review = reviews.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("reviews"))
        facts = facts.join(per_review, "campaign_id", "left")
    return facts.na.fill(0)


def _campaign_rules(policy: AnyPolicy) -> list[tuple[Column, str]]:
    """Condition and code of every blocker that names neither a consumer nor a source."""
    has_envelope = F.col("mode").isNotNull()
    return [
        (not_true("inputs_match"), "POLICY_INPUT_DRIFT"),
        (~has_envelope | (F.col("required_sources") == 0), "EVIDENCE_REQUIRED_SOURCE_INCOMPLETE"),
        (F.col("consumers") == 0, "EVIDENCE_EMPTY_RESULT_UNPROVEN"),
        (policy.flag("requires_live_evidence") & has_envelope & (F.col("mode") != "live"), "EVIDENCE_MODE_NOT_LIVE"),
        (policy.flag("require_reconciliation") & not_true("reconciled"), "RECONCILIATION_REQUIRED"),
    ]


def decide(facts: DataFrame, policy: AnyPolicy = Policy(), keys: tuple[Column | str, ...] = ("campaign_id",)) -> DataFrame:
    """One decision per row of facts, by default per campaign, with the number of blockers and review requirements."""
    forbidden, reviewed = _waivers(policy)
    zero = F.lit(0).cast("bigint")
    blocked = F.col("incomplete_sources") + F.col("unresolved") + F.col("unknown") + F.when(forbidden, F.col("waived")).otherwise(zero)
    for condition, _ in _campaign_rules(policy):
        blocked = blocked + F.coalesce(condition, F.lit(False)).cast("bigint")
    review = F.col("reviews") + F.when(reviewed, F.col("waived")).otherwise(zero)
    unsafe = F.col("unsafe") + F.col("added")
    return facts.withColumn("_b", blocked).withColumn("_u", unsafe).withColumn("_r", review).select(
        *keys,
        F.when(F.col("_u") > 0, "UNSAFE")
        .when(F.col("_b") > 0, "BLOCKED")
        .when(F.col("_r") > 0, "REVIEW_REQUIRED")
        .otherwise("READY_TO_RETIRE")
        .alias("decision"),
        (F.col("_b") + F.col("_u")).alias("blockers"),
        F.col("_r").alias("reviews"),
    )


def consumer_blockers(consumers: DataFrame, added: DataFrame, policy: AnyPolicy = Policy()) -> DataFrame:
    """Blockers and reviews that name a consumer, row by row; for policies by campaign, ``consumers`` carry theirs."""
    d = F.col("disposition")
    forbidden, reviewed = _waivers(policy)
    waiver = F.when(forbidden, F.lit("POLICY_WAIVER_FORBIDDEN")).when(reviewed, F.lit("POLICY_WAIVER_REVIEW"))
    severity_of_waiver = F.when(forbidden, F.lit(BLOCKED)).otherwise(F.lit(REVIEW))
    code = (
        F.when(d.isin(*CLOSED_DISPOSITIONS), F.lit(None))
        .when(d == "WAIVED", waiver)
        .when(d == "UNRESOLVED", F.lit("IDENTITY_NOT_FOUND"))
        .when(d.isin(*OPEN_DISPOSITIONS), F.concat(F.lit("POLICY_CONSUMER_"), d))
        .otherwise(F.lit("CONTRACT_UNKNOWN_DISPOSITION"))
    )
    severity = F.when(d.isin(*OPEN_DISPOSITIONS), UNSAFE).when(d == "WAIVED", severity_of_waiver).otherwise(BLOCKED)
    open_rows = consumers.select("campaign_id", code.alias("code"), "consumer_id", severity.alias("severity"))
    new_rows = added.select(
        "campaign_id", F.lit("RECONCILIATION_NEW_CONSUMER").alias("code"), "consumer_id", F.lit(UNSAFE).alias("severity")
    )
    return open_rows.filter("code IS NOT NULL").unionByName(new_rows)


def campaign_blockers(facts: DataFrame, sources: DataFrame, policy: AnyPolicy = Policy()) -> DataFrame:
    """Blockers that name no consumer; an incomplete source is named instead."""
    rows = facts.select(
        "campaign_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in _campaign_rules(policy)]))).alias("code")
    ).select("campaign_id", "code", F.lit(None).cast("string").alias("source_id"), F.lit(BLOCKED).alias("severity"))
    per_source = sources.filter(F.col("required") & differs(F.col("status"), F.lit("COMPLETE"))).select(
        "campaign_id",
        F.lit("EVIDENCE_REQUIRED_SOURCE_INCOMPLETE").alias("code"),
        "source_id",
        F.lit(BLOCKED).alias("severity"),
    )
    return rows.unionByName(per_source)


def blocker_rows(
    facts: DataFrame,
    sources: DataFrame,
    consumers: DataFrame,
    added: DataFrame,
    reviews: DataFrame | None = None,
    policy: AnyPolicy = Policy(),
) -> DataFrame:
    """Every blocker and review requirement: campaign, code, the consumer or source it names, severity."""
    if isinstance(policy, CampaignPolicy):
        consumers = consumers.join(facts.select("campaign_id", "policy"), "campaign_id", "left")
    rows = (
        campaign_blockers(facts, sources, policy)
        .withColumn("consumer_id", F.lit(None).cast("string"))
        .unionByName(consumer_blockers(consumers, added, policy).withColumn("source_id", F.lit(None).cast("string")))
    )
    if reviews is not None:
        rows = rows.unionByName(
            reviews.select(
                "campaign_id",
                "code",
                F.lit(None).cast("string").alias("source_id"),
                F.lit(REVIEW).alias("severity"),
                "consumer_id",
            )
        )
    return rows


def evaluate(
    campaigns: DataFrame,
    sources: DataFrame,
    consumers: DataFrame,
    inventory: DataFrame,
    current: DataFrame,
    reviews: DataFrame | None = None,
    policy: AnyPolicy = Policy(),
) -> tuple[DataFrame, DataFrame]:
    """Decisions and blocker rows."""
    added = new_consumers(inventory, current)
    facts = campaign_facts(campaigns, sources, consumers, added, reviews)
    return decide(facts, policy), blocker_rows(facts, sources, consumers, added, reviews, policy)


def input_drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Input keys whose digest changed; a key missing on one side has changed."""
    key = ["campaign_id", "input_key"]
    a = recorded.select(*key, F.col("digest").alias("recorded_digest"))
    b = current.select(*key, F.col("digest").alias("current_digest"))
    return a.join(b, key, "full_outer").filter(differs("recorded_digest", "current_digest"))


def membership_diff(inventory: DataFrame, current: DataFrame) -> DataFrame:
    """Each consumer of either set, labelled added, disappeared or unchanged."""
    key = ["campaign_id", "consumer_id"]
    a = inventory.select(*key).distinct().withColumn("_a", F.lit(True))
    b = current.select(*key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").select(
        *key,
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "disappeared").otherwise("unchanged").alias("change"),
    )


def decision_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(
        F.count(F.lit(1)).alias("campaigns"), count_where(F.col("blockers") > 0).alias("with_blockers")
    )
