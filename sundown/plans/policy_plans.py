"""Policy queries: customers stand for campaigns, their orders for consumers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sundown.operators import policy as p
from sundown.operators import truth
from sundown.plans.twin import twin, view
from sundown.sources.tables import Tables
from sundown.vocabulary import OPEN_DISPOSITIONS

STATUSES = ("COMPLETE", "COMPLETE", "PARTIAL", "COMPLETE", "STALE")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def campaigns(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    return t.customer.select(
        F.concat(F.lit("c"), key).alias("campaign_id"),
        F.when(key % 31 == 0, F.lit(None)).when(key % 29 == 0, "fixture").otherwise("live").alias("mode"),
        (key % 7 != 0).alias("reconciled"),
        (key % 37 != 0).alias("inputs_match"),
    )


view("campaigns", """
SELECT 'c' || c_custkey AS campaign_id, CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 'fixture'
       ELSE 'live' END AS mode, c_custkey % 7 <> 0 AS reconciled, c_custkey % 37 <> 0 AS inputs_match FROM customer
""")


def sources(t: Tables) -> DataFrame:
    """A catalog source by nation, and a repository source that only some campaigns require; none without an envelope."""
    key = F.col("c_custkey")
    rows = F.array(
        F.struct(
            F.lit("catalog").alias("source_id"),
            (key % 43 != 0).alias("required"),
            _pick(STATUSES, F.col("c_nationkey") % 5).alias("status"),
        ),
        F.struct(
            F.lit("repository").alias("source_id"),
            ((key % 43 != 0) & (key % 2 == 0)).alias("required"),
            F.when(key % 23 == 0, "UNAVAILABLE").otherwise("COMPLETE").alias("status"),
        ),
    )
    return (
        t.customer.filter(key % 31 != 0)
        .select(F.concat(F.lit("c"), key).alias("campaign_id"), F.explode(rows).alias("s"))
        .select("campaign_id", "s.*")
    )


view("campaign_sources", f"""
SELECT 'c' || c_custkey AS campaign_id, 'catalog' AS source_id, c_custkey % 43 <> 0 AS required,
       {_sql_list(STATUSES)}[c_nationkey % 5 + 1] AS status FROM customer WHERE c_custkey % 31 <> 0
UNION ALL
SELECT 'c' || c_custkey, 'repository', c_custkey % 43 <> 0 AND c_custkey % 2 = 0,
       CASE WHEN c_custkey % 23 = 0 THEN 'UNAVAILABLE' ELSE 'COMPLETE' END FROM customer WHERE c_custkey % 31 <> 0
""")


def consumer_orders(t: Tables) -> DataFrame:
    """Orders by the campaign they count for: those of campaigns of class 5 count for the campaign before."""
    return t.orders.withColumn("o_custkey", F.col("o_custkey") - (F.col("o_custkey") % 6 == 5).cast("int"))


def _order_consumers(t: Tables) -> DataFrame:
    """Orders as consumers; campaigns of class 5 have none."""
    orders = consumer_orders(t)
    order, kind = F.col("o_orderkey"), F.col("o_custkey") % 6
    disposition = (
        F.when((kind == 1) & (order % 4 == 0), "WAIVED")
        .when((kind == 2) & (order % 4 == 0), "UNRESOLVED")
        .when((kind == 3) & (order % 4 == 0), _pick(OPEN_DISPOSITIONS, order % 7))
        .otherwise(_pick(("VALIDATED", "REMOVED", "NOT_APPLICABLE"), order % 3))
    )
    return orders.select(
        F.concat(F.lit("c"), "o_custkey").alias("campaign_id"),
        F.concat(F.lit("o"), "o_orderkey").alias("consumer_id"),
        disposition.alias("disposition"),
        ((kind != 4) | (order % 5 != 0)).alias("in_inventory"),
        ((kind != 0) | (order % 11 != 0)).alias("in_current"),
    )


view("order_consumers", f"""
SELECT 'c' || o_custkey AS campaign_id, 'o' || o_orderkey AS consumer_id,
       CASE WHEN o_custkey % 6 = 1 AND o_orderkey % 4 = 0 THEN 'WAIVED'
            WHEN o_custkey % 6 = 2 AND o_orderkey % 4 = 0 THEN 'UNRESOLVED'
            WHEN o_custkey % 6 = 3 AND o_orderkey % 4 = 0 THEN {_sql_list(OPEN_DISPOSITIONS)}[o_orderkey % 7 + 1]
            ELSE ['VALIDATED', 'REMOVED', 'NOT_APPLICABLE'][o_orderkey % 3 + 1] END AS disposition,
       o_custkey % 6 <> 4 OR o_orderkey % 5 <> 0 AS in_inventory,
       o_custkey % 6 <> 0 OR o_orderkey % 11 <> 0 AS in_current
FROM (SELECT o_orderkey, o_custkey - CASE WHEN o_custkey % 6 = 5 THEN 1 ELSE 0 END AS o_custkey FROM orders)
""")


def consumers(t: Tables) -> DataFrame:
    return _order_consumers(t).select("campaign_id", "consumer_id", "disposition")


def inventory(t: Tables) -> DataFrame:
    return _order_consumers(t).filter("in_inventory").select("campaign_id", "consumer_id")


def current(t: Tables) -> DataFrame:
    return _order_consumers(t).filter("in_current").select("campaign_id", "consumer_id")


def reviews(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    return t.customer.filter(key % 41 == 0).select(
        F.concat(F.lit("c"), key).alias("campaign_id"),
        F.lit("VALIDATION_SEMANTIC_REVIEW").alias("code"),
        F.lit(None).cast("string").alias("consumer_id"),
    )


view("new_consumers", """
SELECT campaign_id, consumer_id FROM order_consumers WHERE in_current
EXCEPT SELECT campaign_id, consumer_id FROM order_consumers WHERE in_inventory
""")


def policy_inputs(t: Tables) -> tuple[DataFrame, ...]:
    return campaigns(t), sources(t), consumers(t), inventory(t), current(t), reviews(t)


def _blocker_view(waived_code: str, waived_severity: int) -> str:
    return f"""
SELECT campaign_id, 'POLICY_INPUT_DRIFT' AS code, NULL::VARCHAR AS source_id, NULL::VARCHAR AS consumer_id, 2 AS severity
FROM campaigns WHERE NOT inputs_match
UNION ALL SELECT campaign_id, 'EVIDENCE_REQUIRED_SOURCE_INCOMPLETE', NULL, NULL, 2 FROM campaigns c
  WHERE NOT EXISTS (SELECT 1 FROM campaign_sources s WHERE s.campaign_id = c.campaign_id AND required)
UNION ALL SELECT campaign_id, 'EVIDENCE_MODE_NOT_LIVE', NULL, NULL, 2 FROM campaigns WHERE mode <> 'live'
UNION ALL SELECT campaign_id, 'EVIDENCE_REQUIRED_SOURCE_INCOMPLETE', source_id, NULL, 2 FROM campaign_sources
  WHERE required AND status <> 'COMPLETE'
UNION ALL SELECT campaign_id, 'EVIDENCE_EMPTY_RESULT_UNPROVEN', NULL, NULL, 2 FROM campaigns
  WHERE campaign_id NOT IN (SELECT campaign_id FROM order_consumers)
UNION ALL SELECT campaign_id, 'RECONCILIATION_REQUIRED', NULL, NULL, 2 FROM campaigns WHERE NOT reconciled
UNION ALL SELECT campaign_id, '{waived_code}', NULL, consumer_id, {waived_severity} FROM order_consumers WHERE disposition = 'WAIVED'
UNION ALL SELECT campaign_id, 'IDENTITY_NOT_FOUND', NULL, consumer_id, 2 FROM order_consumers WHERE disposition = 'UNRESOLVED'
UNION ALL SELECT campaign_id, 'POLICY_CONSUMER_' || disposition, NULL, consumer_id, 3 FROM order_consumers
  WHERE disposition NOT IN ('VALIDATED', 'REMOVED', 'NOT_APPLICABLE', 'WAIVED', 'UNRESOLVED')
UNION ALL SELECT campaign_id, 'RECONCILIATION_NEW_CONSUMER', NULL, consumer_id, 3 FROM new_consumers
UNION ALL SELECT 'c' || c_custkey, 'VALIDATION_SEMANTIC_REVIEW', NULL, NULL, 1 FROM customer WHERE c_custkey % 41 = 0
"""


view("blockers_default", _blocker_view("POLICY_WAIVER_FORBIDDEN", 2))
view("blockers_waivers", _blocker_view("POLICY_WAIVER_REVIEW", 1))


def _decision_view(blockers: str) -> str:
    return f"""
SELECT c.campaign_id, CASE max(b.severity) WHEN 3 THEN 'UNSAFE' WHEN 2 THEN 'BLOCKED' WHEN 1 THEN 'REVIEW_REQUIRED'
       ELSE 'READY_TO_RETIRE' END AS decision,
       count(*) FILTER (WHERE b.severity >= 2) AS blockers, count(*) FILTER (WHERE b.severity = 1) AS reviews
FROM campaigns c LEFT JOIN {blockers} b ON b.campaign_id = c.campaign_id GROUP BY c.campaign_id
"""


view("decisions_default", _decision_view("blockers_default"))
view("decisions_waivers", _decision_view("blockers_waivers"))

_ALLOWING = p.Policy(allow_waivers=True)


def decisions(t: Tables, policy: p.Policy = p.Policy()) -> DataFrame:
    return p.evaluate(*policy_inputs(t), policy=policy)[0]


def blockers(t: Tables, policy: p.Policy = p.Policy()) -> DataFrame:
    return p.evaluate(*policy_inputs(t), policy=policy)[1]


def policies(t: Tables) -> DataFrame:
    """Every campaign with a policy of its own: one of four, or flags left out."""
    key = F.col("c_custkey")
    k = F.floor(key / 6) % 5
    return t.customer.select(F.concat(F.lit("c"), key).alias("campaign_id"), F.when(k < 4, F.struct(
        F.when(k != 3, k != 1).alias("requires_live_evidence"), (k != 2).alias("require_reconciliation"),
        F.when(k != 1, k.isin(2, 3)).alias("allow_waivers"), (k == 3).alias("waivers_satisfy_closure"))).alias("policy"))


view("policy_flags", """
SELECT 'c' || c_custkey AS campaign_id, k <> 1 AS live, k <> 2 AS reconciliation, k IN (2, 3) AS waivers, k = 3 AS closing
FROM (SELECT c_custkey, c_custkey // 6 % 5 AS k FROM customer)
""")
view("blockers_by_policy", """
SELECT b.campaign_id, CASE WHEN code = 'POLICY_WAIVER_FORBIDDEN' AND waivers THEN 'POLICY_WAIVER_REVIEW' ELSE code END AS code, source_id, consumer_id,
       CASE WHEN code = 'POLICY_WAIVER_FORBIDDEN' AND waivers THEN 1 ELSE severity END AS severity
FROM blockers_default b JOIN policy_flags USING (campaign_id)
WHERE NOT (code = 'POLICY_WAIVER_FORBIDDEN' AND closing) AND NOT (code = 'EVIDENCE_MODE_NOT_LIVE' AND NOT live)
  AND NOT (code = 'RECONCILIATION_REQUIRED' AND NOT reconciliation)
""")
view("decisions_by_policy", _decision_view("blockers_by_policy"))


def evaluated_by_policy(t: Tables) -> tuple[DataFrame, DataFrame]:
    first, *rest = policy_inputs(t)
    return p.evaluate(first.join(policies(t), "campaign_id", "left"), *rest, policy=p.CampaignPolicy())


# --- labelled scenarios -------------------------------------------------------------

def scenario_facts(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    return t.customer.select(
        F.concat(F.lit("c"), key).alias("scenario_id"),
        F.when(key % 17 == 0, 0).when(key % 17 == 1, 2).otherwise(1).alias("identity_match_count"),
        (key % 19 != 0).alias("replacement_compatible"),
        _pick(STATUSES, F.col("c_nationkey") % 5).alias("evidence_status"),
        (key % 11 != 0).alias("pagination_complete"),
        (key % 23 != 0).alias("native_data_fresh"),
        F.when(key % 29 == 0, 2).otherwise(0).alias("quality_failures"),
        (key % 7 != 0).alias("reconciled"),
    )


view("scenario_facts", f"""
SELECT 'c' || c_custkey AS scenario_id, CASE c_custkey % 17 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS identity_match_count,
       c_custkey % 19 <> 0 AS replacement_compatible, {_sql_list(STATUSES)}[c_nationkey % 5 + 1] AS evidence_status,
       c_custkey % 11 <> 0 AS pagination_complete, c_custkey % 23 <> 0 AS native_data_fresh,
       CASE WHEN c_custkey % 29 = 0 THEN 2 ELSE 0 END AS quality_failures, c_custkey % 7 <> 0 AS reconciled FROM customer
""")


def _entry(code: str, severity: int):
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))


def observed_decisions(t: Tables) -> DataFrame:
    """The policy on the scenario facts, plus the preconditions checked before it."""
    facts = scenario_facts(t)
    as_campaign = facts.select(
        F.col("scenario_id").alias("campaign_id"), F.lit("live").alias("mode"), "reconciled", F.lit(True).alias("inputs_match")
    )
    status = F.when(~F.col("native_data_fresh"), "STALE").otherwise(F.col("evidence_status"))
    as_source = facts.select(
        F.col("scenario_id").alias("campaign_id"), F.lit("catalog").alias("source_id"), F.lit(True).alias("required"),
        status.alias("status"),
    )
    decided, rows = p.evaluate(as_campaign, as_source, consumers(t), inventory(t), current(t))
    count = F.col("identity_match_count")
    extra = facts.select(
        F.col("scenario_id").alias("campaign_id"),
        F.explode(F.array_compact(F.array(
            F.when(count == 0, _entry("IDENTITY_NOT_FOUND", p.BLOCKED)),
            F.when(~count.isin(0, 1), _entry("IDENTITY_AMBIGUOUS", p.BLOCKED)),
            F.when(~F.col("replacement_compatible"), _entry("SPEC_REPLACEMENT_INCOMPATIBLE", p.UNSAFE)),
            F.when(~F.col("pagination_complete"), _entry("EVIDENCE_PAGINATION_FAILED", p.BLOCKED)),
            F.when(F.col("quality_failures") > 0, _entry("VALIDATION_RECEIPT_FAILED", p.UNSAFE)),
        ))).alias("_e"),
    ).select("campaign_id", "_e.*")
    codes = (
        rows.filter(F.col("severity") > p.REVIEW).select("campaign_id", "code", "severity").unionByName(extra)
        .groupBy("campaign_id", "code").agg(F.max("severity").alias("severity"))
        .groupBy("campaign_id").agg(F.max("severity").alias("worst"), F.array_sort(F.collect_set("code")).alias("codes"))
    )
    return decided.join(codes, "campaign_id", "left").select(
        F.col("campaign_id").alias("scenario_id"),
        F.when(F.col("worst") == p.UNSAFE, "UNSAFE").when(F.col("worst") == p.BLOCKED, "BLOCKED")
        .otherwise(F.col("decision")).alias("decision"),
        F.coalesce(F.concat_ws(",", "codes"), F.lit("")).alias("codes"),
    )


def expected(t: Tables) -> DataFrame:
    def as_scenario(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("campaign_id", "scenario_id")

    return truth.expected_decisions(
        scenario_facts(t), as_scenario(consumers(t)), as_scenario(inventory(t)), as_scenario(current(t)))


view("expected_codes", """
SELECT DISTINCT scenario_id, code, harmful FROM (
  SELECT scenario_id, 'IDENTITY_NOT_FOUND' AS code, false AS harmful FROM scenario_facts WHERE identity_match_count = 0
  UNION ALL SELECT scenario_id, 'IDENTITY_AMBIGUOUS', false FROM scenario_facts WHERE identity_match_count > 1
  UNION ALL SELECT scenario_id, 'SPEC_REPLACEMENT_INCOMPATIBLE', true FROM scenario_facts WHERE NOT replacement_compatible
  UNION ALL SELECT scenario_id, 'EVIDENCE_REQUIRED_SOURCE_INCOMPLETE', false FROM scenario_facts
    WHERE evidence_status <> 'COMPLETE' OR NOT native_data_fresh
  UNION ALL SELECT scenario_id, 'EVIDENCE_PAGINATION_FAILED', false FROM scenario_facts WHERE NOT pagination_complete
  UNION ALL SELECT scenario_id, 'VALIDATION_RECEIPT_FAILED', true FROM scenario_facts WHERE quality_failures > 0
  UNION ALL SELECT scenario_id, 'RECONCILIATION_REQUIRED', false FROM scenario_facts WHERE NOT reconciled
  UNION ALL SELECT campaign_id, 'IDENTITY_NOT_FOUND', false FROM order_consumers WHERE disposition = 'UNRESOLVED'
  UNION ALL SELECT campaign_id, 'POLICY_WAIVER_FORBIDDEN', false FROM order_consumers WHERE disposition = 'WAIVED'
  UNION ALL SELECT campaign_id, 'POLICY_CONSUMER_' || disposition, true FROM order_consumers
    WHERE disposition NOT IN ('VALIDATED', 'REMOVED', 'NOT_APPLICABLE', 'WAIVED', 'UNRESOLVED')
  UNION ALL SELECT campaign_id, 'RECONCILIATION_NEW_CONSUMER', true FROM new_consumers)
""")
view("expected_decisions", """
SELECT f.scenario_id, CASE WHEN bool_or(harmful) THEN 'UNSAFE' WHEN count(code) > 0 THEN 'BLOCKED' ELSE 'READY_TO_RETIRE' END AS decision,
       coalesce(string_agg(code, ',' ORDER BY code), '') AS codes
FROM scenario_facts f LEFT JOIN expected_codes USING (scenario_id) GROUP BY f.scenario_id
""")
# The policy blocks an empty inventory; the truth labels do not know that rule.
view("observed_codes", """
SELECT scenario_id, code, harmful FROM expected_codes
UNION SELECT scenario_id, 'EVIDENCE_EMPTY_RESULT_UNPROVEN', false FROM scenario_facts
  WHERE scenario_id NOT IN (SELECT campaign_id FROM order_consumers)
""")
view("decision_comparison", """
SELECT *, observed_decision = expected_decision AND observed_codes = expected_codes AS matched,
       observed_decision = 'READY_TO_RETIRE' AND expected_decision <> 'READY_TO_RETIRE' AS false_ready
FROM (
  SELECT f.scenario_id, CASE WHEN bool_or(harmful) THEN 'UNSAFE' WHEN count(code) > 0 THEN 'BLOCKED' ELSE 'READY_TO_RETIRE' END
         AS observed_decision, coalesce(string_agg(code, ',' ORDER BY code), '') AS observed_codes
  FROM scenario_facts f LEFT JOIN observed_codes USING (scenario_id) GROUP BY f.scenario_id
) JOIN (SELECT scenario_id, decision AS expected_decision, codes AS expected_codes FROM expected_decisions) USING (scenario_id)
""")


def _inputs(t: Tables, drifted: bool) -> DataFrame:
    """Three input digests per campaign; in the current set one changes, one is missing and one is new for some."""
    key = F.col("c_custkey")
    if not drifted:
        entries = {n: F.lit(True) for n in ("policy", "validator", "authorization")}
        version = F.lit("1")
    else:
        entries = {
            "policy": F.lit(True), "validator": key % 13 != 0, "authorization": F.lit(True), "catalog": key % 17 == 0,
        }
        version = F.when(key % 37 == 0, "2").otherwise("1")
    rows = F.array(*[
        F.when(held, F.struct(F.lit(name).alias("input_key"),
                              F.sha2(F.concat(F.lit(f"{name}:"), version if name == "policy" else F.lit("1")), 256).alias("digest")))
        for name, held in entries.items()
    ])
    return t.customer.select(F.concat(F.lit("c"), key).alias("campaign_id"), F.explode(F.array_compact(rows)).alias("i")).select(
        "campaign_id", "i.*")


_Q = lambda build: (lambda spark, folder: build(Tables(spark, folder)))
_NAMED = "campaign_id, code, coalesce(source_id, '') AS source_id, coalesce(consumer_id, '') AS consumer_id, severity"


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("campaign_id", "code", F.coalesce("source_id", F.lit("")).alias("source_id"),
                       F.coalesce("consumer_id", F.lit("")).alias("consumer_id"), "severity")


QUERIES = {
    "f1_decisions": _Q(decisions),
    "f1_decisions_allowing_waivers": _Q(lambda t: decisions(t, _ALLOWING)),
    "f1_decisions_by_policy": _Q(lambda t: evaluated_by_policy(t)[0]),
    "f1_blockers_by_policy": _Q(lambda t: _named(evaluated_by_policy(t)[1])),
    "f1_blockers": _Q(lambda t: _named(blockers(t))),
    "f1_blockers_allowing_waivers": _Q(lambda t: _named(blockers(t, _ALLOWING))),
    "f2_new_consumers": _Q(lambda t: p.new_consumers(inventory(t), current(t))),
    "f3_expected_decisions": _Q(expected),
    "f4_decision_comparison": _Q(lambda t: truth.compare_decisions(observed_decisions(t), expected(t))),
    "f4_comparison_summary": _Q(lambda t: truth.comparison_summary(truth.compare_decisions(observed_decisions(t), expected(t)))),
    "f5_input_drift": _Q(lambda t: p.input_drift(_inputs(t, False), _inputs(t, True)).select(
        "campaign_id", "input_key", F.col("recorded_digest").isNull().alias("recorded_missing"),
        F.col("current_digest").isNull().alias("current_missing"))),
    "h1_membership_diff": _Q(lambda t: p.membership_diff(inventory(t), current(t))),
}

ORACLES = {
    "f1_decisions": twin("SELECT * FROM decisions_default"),
    "f1_decisions_allowing_waivers": twin("SELECT * FROM decisions_waivers"),
    "f1_decisions_by_policy": twin("SELECT * FROM decisions_by_policy"),
    "f1_blockers_by_policy": twin(f"SELECT {_NAMED} FROM blockers_by_policy"),
    "f1_blockers": twin(f"SELECT {_NAMED} FROM blockers_default"),
    "f1_blockers_allowing_waivers": twin(f"SELECT {_NAMED} FROM blockers_waivers"),
    "f2_new_consumers": twin("SELECT * FROM new_consumers"),
    "f3_expected_decisions": twin("SELECT * FROM expected_decisions"),
    "f4_decision_comparison": twin("SELECT * FROM decision_comparison"),
    "f4_comparison_summary": twin("""
SELECT count(*) FILTER (WHERE matched) AS matched_scenarios, count(*) FILTER (WHERE NOT matched) AS diverged_scenarios,
       count(*) FILTER (WHERE false_ready) AS false_readiness, true AS corrupt_truth_rejected FROM decision_comparison"""),
    "f5_input_drift": """
SELECT 'c' || c_custkey AS campaign_id, 'policy' AS input_key, false AS recorded_missing, false AS current_missing
FROM customer WHERE c_custkey % 37 = 0
UNION ALL SELECT 'c' || c_custkey, 'validator', false, true FROM customer WHERE c_custkey % 13 = 0
UNION ALL SELECT 'c' || c_custkey, 'catalog', true, false FROM customer WHERE c_custkey % 17 = 0""",
    "h1_membership_diff": twin("""
SELECT campaign_id, consumer_id, CASE WHEN in_inventory AND in_current THEN 'unchanged' WHEN in_current THEN 'added'
       ELSE 'disappeared' END AS change FROM order_consumers WHERE in_inventory OR in_current"""),
}
