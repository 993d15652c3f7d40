"""Report queries over the policy campaigns, the event logs and the gate attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.operators import report as r
from sundown.plans import events_plans as ep
from sundown.plans import gate_plans as gp
from sundown.plans import policy_plans as pp
from sundown.plans.twin import twin, view
from sundown.sources.tables import Tables

NOW = "2024-01-31 00:00:00"
STUCK_SECONDS = 86_400


def now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def consumers(t: Tables) -> DataFrame:
    """Order consumers with the receipt that some of them carry."""
    number = F.substring("consumer_id", 2, 20).cast("bigint")
    return pp.consumers(t).withColumn(
        "receipt_digest", F.when((F.col("disposition") != "REMOVED") & (number % 5 != 0), F.concat(F.lit("r"), number)))


view("receipted_consumers", """
SELECT *, CASE WHEN disposition <> 'REMOVED' AND k % 5 <> 0 THEN 'r' || k END AS receipt_digest
FROM (SELECT campaign_id, consumer_id, disposition, CAST(substr(consumer_id, 2) AS BIGINT) AS k FROM order_consumers)
""")


def published(t: Tables) -> DataFrame:
    return t.customer.filter(F.col("c_custkey") % 3 == 0).select(F.concat(F.lit("c"), "c_custkey").alias("campaign_id"))


def source_limits(t: Tables) -> DataFrame:
    """Campaign sources with a limitation text, some of which must not be published."""
    number = F.substring("campaign_id", 2, 20).cast("bigint")
    return pp.sources(t).withColumn(
        "limitation",
        F.when(number % 7 == 0, F.concat(F.lit(" read as someone@example.org for "), number))
        .when(number % 11 == 0, F.lit("kept in /home/someone"))
        .when(number % 13 == 0, F.lit("  "))
        .otherwise(F.concat(F.lit(" page limit "), number, F.lit(" "))))


WITHHELD = "A source limitation is recorded in the private manifest."

_Q = lambda build: (lambda spark, folder: build(Tables(spark, folder)))


def metrics(t: Tables) -> DataFrame:
    return r.operational_metrics(ep.log(t, True), gp.attempts(t), ep.claims(t), now(), STUCK_SECONDS)


QUERIES = {
    "i1_campaign_rollup": _Q(lambda t: r.campaign_rollup(pp.decisions(t), consumers(t), published(t))),
    "i1_receipt_states": _Q(lambda t: consumers(t).groupBy(
        r.receipt_state(F.col("disposition"), F.col("receipt_digest")).alias("receipt_state")).agg(F.count(F.lit(1)).alias("consumers"))),
    "i2_source_coverage": _Q(lambda t: r.source_coverage(pp.campaigns(t), pp.sources(t))),
    "i3_blocker_recovery": _Q(lambda t: r.explain_blockers(pp.blockers(t).select("campaign_id", "code")).groupBy(
        "code", "evidence_source", "recovery_action").agg(F.count(F.lit(1)).alias("blockers"))),
    "i4_operational_metrics": _Q(metrics),
    "i4_health": _Q(lambda t: r.health(metrics(t))),
    "i4_stuck_campaigns": _Q(lambda t: r.stuck_campaigns(ep.log(t, True), now(), STUCK_SECONDS)),
    "i5_public_consumers": _Q(lambda t: r.public_consumers(consumers(t))),
    "i5_public_sources": _Q(lambda t: r.public_sources(source_limits(t))),
    "i6_campaign_summary": _Q(lambda t: r.campaign_summary(r.manifest(ep.log(t, False))).select(
        "campaign_id", "decision", "blockers", "evidence_envelope_digest", "manifest_digest", "scope_statement")),
}

view("metric_rows", f"""
SELECT 'campaign_state' AS metric, state AS label, count(*) AS value FROM daily_fold GROUP BY 2
UNION ALL SELECT 'event_type', event_type, count(*) FROM daily_stream GROUP BY 2
UNION ALL SELECT 'gate_status', status, count(*) FROM gate_attempts GROUP BY 2
UNION ALL SELECT 'gate_refusal', refusal_code, count(*) FROM gate_attempts WHERE refusal_code IS NOT NULL GROUP BY 2
UNION ALL SELECT 'repeated_refusal', refusal_code, count(*) FROM gate_attempts WHERE refusal_code IS NOT NULL GROUP BY 2 HAVING count(*) >= 3
UNION ALL SELECT 'stuck_campaigns', '', count(*) FROM daily_fold
  WHERE state NOT IN ('BLOCKED', 'READY', 'RETIRED') AND TIMESTAMP '{NOW}' - date_trunc('second', last_at) > INTERVAL {STUCK_SECONDS} SECOND
UNION ALL SELECT 'stale_campaigns', '', count(*) FROM daily_fold WHERE envelope_event % 5 IN (2, 4)
UNION ALL SELECT 'unknown_outcomes', '', count(*) FROM gate_attempts WHERE status = 'OUTCOME_UNKNOWN'
UNION ALL SELECT 'pending_intents', '', count(*) FROM gate_attempts WHERE status = 'INTENT_RECORDED'
UNION ALL SELECT 'active_claims', '', count(*) FROM events WHERE day(ts) <= 5
""")

# The texts a reader must find, written out apart from the operators'.
_RECOVERY_SQL = """('EVIDENCE', 'evidence envelope', 'Refresh or restore the required source, verify complete pagination and freshness, then inventory or reconcile again.'),
  ('IDENTITY', 'native identity mapping', 'Resolve exactly one native object for the consumer before planning a change.'),
  ('VALIDATION', 'source-native validator', 'Fix the native validation failure and obtain a new passing receipt.'),
  ('RECONCILIATION', 'fresh reconciliation', 'Refresh equivalent evidence scope and reconcile the complete observed set again.'),
  ('POLICY', 'campaign policy', 'Resolve the named consumer state or policy input, then evaluate again.')"""

ORACLES = {
    "i1_campaign_rollup": twin("""
SELECT d.campaign_id, decision, coalesce(c.n, 0) AS consumers, coalesce(c.closed, 0) AS closed, coalesce(c.n - c.closed, 0) AS open, blockers, reviews,
       blockers + reviews AS conditions, coalesce(c.receipts, 0) AS receipts,
       CASE WHEN decision = 'READY_TO_RETIRE' AND CAST(substr(d.campaign_id, 2) AS BIGINT) % 3 <> 0 THEN
              'Publish and verify the campaign summary, then prepare one short-lived producer plan and run the gate.'
            WHEN decision = 'READY_TO_RETIRE' THEN 'Prepare one short-lived producer plan and run the gate immediately before the producer change.'
            WHEN decision = 'REVIEW_REQUIRED' THEN 'Resolve the recorded review requirement, preserve any residual risk, then reconcile and evaluate again.'
            WHEN decision = 'BLOCKED' THEN 'Resolve the blocking evidence or authorization, then resume at the step named below.'
            WHEN decision = 'UNSAFE' THEN 'Migrate or resolve every unsafe consumer, validate in its native system, then reconcile again.' END AS next_action
FROM decisions_default d LEFT JOIN (SELECT campaign_id, count(*) AS n, count(*) FILTER (WHERE disposition IN ('VALIDATED', 'REMOVED', 'NOT_APPLICABLE')) AS closed,
  count(receipt_digest) AS receipts FROM receipted_consumers GROUP BY 1) c USING (campaign_id)"""),
    "i1_receipt_states": twin("""
SELECT CASE WHEN disposition = 'STALE' THEN 'STALE' WHEN receipt_digest IS NULL THEN 'MISSING' WHEN disposition = 'VALIDATED' THEN 'VALIDATED' ELSE 'RECORDED' END
       AS receipt_state, count(*) AS consumers FROM receipted_consumers GROUP BY 1"""),
    "i2_source_coverage": twin("""
SELECT campaign_id, CASE WHEN req = 0 THEN 'UNKNOWN' WHEN done < req THEN 'INCOMPLETE' WHEN mode IS DISTINCT FROM 'live' THEN 'NON_LIVE' ELSE 'BOUNDED_COMPLETE' END AS coverage,
       req AS required, done AS complete, req - done AS gaps
FROM (SELECT c.campaign_id, c.mode, count(*) FILTER (WHERE required) AS req, count(*) FILTER (WHERE required AND status = 'COMPLETE') AS done
      FROM campaigns c LEFT JOIN campaign_sources s USING (campaign_id) GROUP BY 1, 2)"""),
    "i3_blocker_recovery": twin(f"""
SELECT code, s AS evidence_source, a AS recovery_action, count(*) AS blockers FROM blockers_default
JOIN (VALUES {_RECOVERY_SQL}) v(family, s, a) ON family = split_part(code, '_', 1) GROUP BY 1, 2, 3"""),
    "i4_operational_metrics": twin("SELECT * FROM metric_rows"),
    "i4_health": twin("""
SELECT count(*) FILTER (WHERE alerting) = 0 AS healthy, count(*) FILTER (WHERE alerting) AS alerts FROM (
  SELECT metric IN ('stuck_campaigns', 'stale_campaigns', 'repeated_refusal', 'unknown_outcomes', 'pending_intents') AND value > 0 AS alerting FROM metric_rows)"""),
    "i4_stuck_campaigns": twin(f"""
SELECT 'sha256:' || sha256('"' || campaign_id || '"') AS campaign_id_digest, state,
       CAST(epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', last_at)) AS BIGINT) AS age_seconds FROM daily_fold
WHERE state NOT IN ('BLOCKED', 'READY', 'RETIRED') AND TIMESTAMP '{NOW}' - date_trunc('second', last_at) > INTERVAL {STUCK_SECONDS} SECOND"""),
    "i5_public_consumers": twin("""
SELECT campaign_id, 'consumer-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS label, disposition,
       disposition IN ('VALIDATED', 'REMOVED', 'NOT_APPLICABLE') AS closed,
       CASE WHEN disposition = 'STALE' THEN 'STALE — recorded receipt is not acceptable now'
            WHEN receipt_digest IS NULL THEN 'MISSING — no accepted native validation receipt'
            WHEN disposition = 'VALIDATED' THEN 'VALIDATED — native receipt accepted at manifest time'
            ELSE 'RECORDED — receipt does not close the current state' END AS receipt_state
FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY consumer_id) AS n FROM receipted_consumers)"""),
    "i5_public_sources": twin(f"""
SELECT campaign_id, 'declared-source-' || row_number() OVER (PARTITION BY campaign_id ORDER BY source_id) AS label, required, status,
       CASE WHEN k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0 THEN '{WITHHELD}' ELSE 'page limit ' || k END AS limitation
FROM (SELECT *, CAST(substr(campaign_id, 2) AS BIGINT) AS k FROM campaign_sources)"""),
    "i6_campaign_summary": twin("""
SELECT campaign_id, decision, blockers, envelope_digest AS evidence_envelope_digest, manifest_digest,
       'This decision is bounded by the recorded evidence envelope and does not claim universal safety.' AS scope_statement FROM manifest_rows"""),
}
