"""Event-log queries: warehouse events become campaign logs, per user and per user and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.functions.ordered import TIME_BITS, sliced_before, sliced_numbers
from sundown.operators import events as ev
from sundown.operators import report as r
from sundown.plans.twin import twin, view
from sundown.session import cut_lineage
from sundown.sources.tables import Tables
from sundown.vocabulary import CAMPAIGN_MOVES, CONSUMER_MOVES, DISPOSITIONS, IMPORTABLE_DISPOSITIONS, pairs

STATUSES = ("COMPLETE", "COMPLETE", "PARTIAL", "COMPLETE", "STALE")


def eid() -> Column:
    return F.col("event_id")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _div(by: int) -> Column:
    return F.floor(eid() / by)


def base_stream(t: Tables, daily: bool) -> DataFrame:
    """Events numbered inside their campaign, with the lifecycle event each stands for."""
    campaign = F.concat(F.lit("u"), F.col("user_id"))
    if daily:
        campaign = F.concat(campaign, F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
    base = t.events.select(
        campaign.alias("campaign_id"), "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("occurred_at"))
    numbered = sliced_numbers(
        base, ["campaign_id"], ["occurred_at", "event_id"], "sequence", position=F.unix_micros("occurred_at"), bits=TIME_BITS)
    kind = F.col("event_type")
    lifecycle = (
        F.when(F.col("sequence") == 1, "CAMPAIGN_CREATED")
        .when(kind == "signup", F.when(eid() % 3 == 0, "INVENTORY_EXTENDED").otherwise("INVENTORY_RECORDED"))
        .when(kind == "view", _pick(("MIGRATION_STARTED", "CONSUMER_DISPOSITION_CHANGED", "RECEIPT_ACCEPTED"), eid() % 3))
        .when(kind == "click", "RECONCILIATION_RECORDED")
        .when(kind == "purchase", F.when(eid() % 5 == 4, "WAIVER_RECORDED").otherwise("POLICY_EVALUATED"))
        .otherwise(_pick(("CAMPAIGN_RESUMED", "CAMPAIGN_RETIRED", "CAMPAIGN_BLOCKED", "CAMPAIGN_BLOCKED"), eid() % 4))
    )
    return numbered.withColumn("kind", kind).withColumn("event_type", lifecycle)


def _stream_view(campaign: str) -> str:
    return f"""
SELECT *, CASE WHEN sequence = 1 THEN 'CAMPAIGN_CREATED'
  WHEN kind = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'INVENTORY_EXTENDED' ELSE 'INVENTORY_RECORDED' END
  WHEN kind = 'view' THEN ['MIGRATION_STARTED', 'CONSUMER_DISPOSITION_CHANGED', 'RECEIPT_ACCEPTED'][event_id % 3 + 1]
  WHEN kind = 'click' THEN 'RECONCILIATION_RECORDED'
  WHEN kind = 'purchase' THEN CASE WHEN event_id % 5 = 4 THEN 'WAIVER_RECORDED' ELSE 'POLICY_EVALUATED' END
  ELSE ['CAMPAIGN_RESUMED', 'CAMPAIGN_RETIRED', 'CAMPAIGN_BLOCKED', 'CAMPAIGN_BLOCKED'][event_id % 4 + 1] END AS event_type
FROM (SELECT {campaign} AS campaign_id, event_id, user_id, event_type AS kind, value, ts AS occurred_at,
      row_number() OVER (PARTITION BY {campaign} ORDER BY ts, event_id) AS sequence FROM events)
"""


view("daily_stream", _stream_view("'u' || user_id || '-' || strftime(ts, '%Y-%m-%d')"))
view("user_stream", _stream_view("'u' || user_id"))


def members() -> Column:
    """Two consumers named by an event, with importable dispositions except for a planted closed one."""
    return F.array(
        F.struct(
            F.concat(F.lit("k"), eid() % 5).alias("id"),
            F.when(eid() % 37 == 0, "VALIDATED").otherwise(_pick(IMPORTABLE_DISPOSITIONS, eid() % 4)).alias("disposition"),
        ),
        F.struct(
            F.concat(F.lit("k"), _div(5) % 5 + 5).alias("id"),
            _pick(IMPORTABLE_DISPOSITIONS, _div(4) % 4).alias("disposition"),
        ),
    )


view("stream_members", f"""
SELECT campaign_id, sequence, event_type, event_id, occurred_at, 'k' || event_id % 5 AS consumer_id,
       CASE WHEN event_id % 37 = 0 THEN 'VALIDATED' ELSE {_sql_list(IMPORTABLE_DISPOSITIONS)}[event_id % 4 + 1] END AS disposition
FROM user_stream WHERE event_type IN ('INVENTORY_RECORDED', 'INVENTORY_EXTENDED', 'RECONCILIATION_RECORDED')
UNION ALL
SELECT campaign_id, sequence, event_type, event_id, occurred_at, 'k' || (event_id // 5 % 5 + 5),
       {_sql_list(IMPORTABLE_DISPOSITIONS)}[event_id // 4 % 4 + 1]
FROM user_stream WHERE event_type IN ('INVENTORY_RECORDED', 'INVENTORY_EXTENDED', 'RECONCILIATION_RECORDED')
""")
view("stream_changes", f"""
SELECT campaign_id, sequence, event_type, event_id, occurred_at, 'k' || event_id % 10 AS consumer_id,
       CASE event_type WHEN 'WAIVER_RECORDED' THEN 'WAIVED' WHEN 'RECEIPT_ACCEPTED' THEN 'VALIDATED'
            ELSE {_sql_list(DISPOSITIONS)}[event_id // 10 % 12 + 1] END AS disposition
FROM user_stream WHERE event_type IN ('CONSUMER_DISPOSITION_CHANGED', 'WAIVER_RECORDED', 'RECEIPT_ACCEPTED')
""")

# What an evaluation finds in a campaign that has recorded nothing yet.
EMPTY_CODES = ("EVIDENCE_EMPTY_RESULT_UNPROVEN", "EVIDENCE_REQUIRED_SOURCE_INCOMPLETE", "RECONCILIATION_REQUIRED")


def campaign_policy() -> Column:
    """The policy a campaign is created with: none, or one of four."""
    k = F.col("user_id") % 5
    return F.when(k > 0, F.struct(
        (k != 3).alias("requires_live_evidence"), F.when(k != 4, True).otherwise(False).alias("require_reconciliation"),
        k.isin(1, 2).alias("allow_waivers"), F.when(k != 1, k == 2).alias("waivers_satisfy_closure")))


view("campaign_policies", """
SELECT DISTINCT 'u' || user_id AS campaign_id, user_id % 5 <> 3 AS live, user_id % 5 <> 4 AS reconciliation,
       user_id % 5 IN (1, 2) AS waivers, user_id % 5 = 2 AS closing FROM events
""")


def payload() -> Column:
    """The JSON payload of each event."""
    kind = F.col("event_type")

    def only(types: tuple[str, ...], value: Column) -> Column:
        return F.when(kind.isin(*types), value)

    membership = ("INVENTORY_RECORDED", "INVENTORY_EXTENDED", "RECONCILIATION_RECORDED")
    inputs = F.create_map(
        F.lit("policy"), F.when((eid() % 6 == 0) & (kind == "POLICY_EVALUATED"), "p2").otherwise("p1"), F.lit("validator"), F.lit("v1"))
    return F.to_json(F.struct(
        only(membership, members()).alias("consumers"),
        only(("RECONCILIATION_RECORDED",), F.transform(members(), lambda c: c["id"])).alias("consumer_ids"),
        only(("CONSUMER_DISPOSITION_CHANGED", "RECEIPT_ACCEPTED"), F.concat(F.lit("k"), eid() % 10)).alias("consumer_id"),
        only(("CONSUMER_DISPOSITION_CHANGED",), _pick(DISPOSITIONS, _div(10) % 12)).alias("disposition"),
        only(("CAMPAIGN_RESUMED",), _pick(("INVENTORIED", "MIGRATING", "RECONCILING"), _div(4) % 3)).alias("state"),
        only(("POLICY_EVALUATED",), _pick(("BLOCKED", "UNSAFE", "READY_TO_RETIRE"), eid() % 3)).alias("decision"),
        only(("POLICY_EVALUATED",), F.when(eid() % 2 == 0, F.array(*[F.lit(c) for c in EMPTY_CODES])).otherwise(
            F.array(F.lit("RECONCILIATION_REQUIRED"), F.lit("IDENTITY_NOT_FOUND"), F.lit("IDENTITY_NOT_FOUND")))).alias("blocker_codes"),
        only(membership, F.struct(
            F.when(eid() % 13 == 0, "replay").otherwise("live").alias("mode"),
            F.array(F.struct(F.lit("catalog").alias("id"), (eid() % 17 != 0).alias("required"), _pick(STATUSES, eid() % 5).alias("status")))
            .alias("sources"))).alias("evidence_envelope"),
        only(("CAMPAIGN_CREATED", "POLICY_EVALUATED"), inputs).alias("input_digests"),
        only(("CAMPAIGN_CREATED",), campaign_policy()).alias("policy"),
        only(("RECEIPT_ACCEPTED",), F.struct(
            F.concat(F.lit("r"), eid()).alias("receipt_digest"),
            F.when(eid() % 7 != 0, F.date_format(F.timestamp_add("DAY", (eid() % 5).cast("int"), F.col("occurred_at")),
                                              "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("expires_at"))).alias("receipt"),
        only(("WAIVER_RECORDED",), F.struct(F.concat(F.lit("k"), eid() % 10).alias("consumer_id"))).alias("waiver"),
    ))


def event_digest() -> Column:
    return F.sha2(F.concat_ws("|", "campaign_id", F.col("sequence").cast("string"), eid().cast("string"), "event_type"), 256)


_DIGEST_SQL = "sha256(campaign_id || '|' || sequence || '|' || event_id || '|' || event_type)"


def log(t: Tables, daily: bool) -> DataFrame:
    """The log, landed as a table: the audits read it more than once, each time only some columns."""
    return cut_lineage(base_stream(t, daily).select(
        "campaign_id", "sequence", "event_type", "occurred_at", F.concat(F.lit("e"), eid()).alias("idempotency_key"),
        event_digest().alias("event_digest"), payload().alias("payload"), "event_id", "user_id", "value"))


def damaged_chain(t: Tables, daily: bool = True) -> DataFrame:
    """The log with chained digests and planted damage: gaps, broken links, clocks set back, no creation."""
    chained = sliced_before(
        base_stream(t, daily).withColumn("event_digest", event_digest()), ["campaign_id"], ["sequence"],
        last={"previous_event_digest": F.col("event_digest")})
    return chained.select(
        "campaign_id",
        F.when(eid() % 53 == 0, F.col("sequence") + 1).otherwise(F.col("sequence")).alias("sequence"),
        F.when((F.col("user_id") % 23 == 0) & (F.col("sequence") == 1), "MIGRATION_STARTED").otherwise(F.col("event_type")).alias("event_type"),
        F.when(eid() % 61 == 0, F.timestamp_add("HOUR", F.lit(-20), F.col("occurred_at"))).otherwise(F.col("occurred_at")).alias("occurred_at"),
        F.when(eid() % 59 == 0, F.lit("broken")).otherwise(F.col("previous_event_digest")).alias("previous_event_digest"),
        "event_digest", "event_id")


def _damaged_view(stream: str) -> str:
    return f"""
SELECT campaign_id, CASE WHEN event_id % 53 = 0 THEN sequence + 1 ELSE sequence END AS sequence,
       CASE WHEN user_id % 23 = 0 AND sequence = 1 THEN 'MIGRATION_STARTED' ELSE event_type END AS event_type,
       CASE WHEN event_id % 61 = 0 THEN occurred_at - INTERVAL 20 HOUR ELSE occurred_at END AS occurred_at,
       CASE WHEN event_id % 59 = 0 THEN 'broken' ELSE prev END AS previous_event_digest, digest AS event_digest
FROM (SELECT *, lag(digest) OVER (PARTITION BY campaign_id ORDER BY sequence) AS prev FROM (SELECT *, {_DIGEST_SQL} AS digest FROM {stream}))
"""


def _audit_view(damaged: str) -> str:
    """The stored order replayed row by row: the first row whose number is not its position fails."""
    return f"""
SELECT campaign_id, sequence AS failed_seq, expected,
       CASE WHEN sequence <> expected THEN 'INTEGRITY_EVENT_SEQUENCE_INVALID'
            WHEN previous_event_digest IS DISTINCT FROM before THEN 'INTEGRITY_EVENT_CHAIN_MISMATCH'
            WHEN occurred_at < time_before THEN 'RUNTIME_CLOCK_ROLLBACK' END AS code FROM (
  SELECT *, row_number() OVER w AS expected, lag(event_digest) OVER w AS before, lag(occurred_at) OVER w AS time_before
  FROM {damaged} WINDOW w AS (PARTITION BY campaign_id ORDER BY sequence, event_digest))
"""


view("damaged", _damaged_view("daily_stream"))
view("damaged_users", _damaged_view("user_stream"))
view("audit_codes", _audit_view("damaged"))
view("audit_codes_users", _audit_view("damaged_users"))


def stream_campaigns(t: Tables) -> DataFrame:
    """Every daily campaign, and one per user that never recorded an event."""
    daily = t.events.select(F.concat(F.lit("u"), F.col("user_id"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("campaign_id"))
    silent = t.events.select(F.concat(F.lit("u"), F.col("user_id"), F.lit("-silent")).alias("campaign_id"))
    return daily.unionByName(silent).distinct()


def arrivals(t: Tables) -> DataFrame:
    """The daily log as delivered: every ninth event twice, every forty-seventh again with other content."""
    rows = log(t, True).select("campaign_id", "idempotency_key", "sequence", "event_type", "payload", "event_id")
    again = rows.filter(eid() % 9 == 0)
    other = rows.filter(eid() % 47 == 0).withColumn("payload", F.lit('{"state":"RETIRED"}')).withColumn("event_type", F.lit("CAMPAIGN_RETIRED"))
    return rows.unionByName(again).unionByName(other).drop("event_id")


def snapshot_and_delta(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The fold of the log's first three weeks, stored, and the events since, landed as a table of their own."""
    events = log(t, False)
    early = F.dayofmonth("occurred_at") <= 21
    return cut_lineage(ev.campaign_fold(events.filter(early))), cut_lineage(events.filter(~early))


def _state_row(state: DataFrame) -> DataFrame:
    return state.select(
        "campaign_id", "state", _time("last_event_at").alias("last_event_at"), "events", "reconciled",
        F.coalesce("envelope.mode", F.lit("")).alias("mode"), "snapshots", "receipts", "head_digest")


# --- twins of the consumer rules ----------------------------------------------------

view("stream_epochs", """
SELECT *, coalesce(max(CASE WHEN event_type = 'INVENTORY_RECORDED' THEN sequence END) OVER w, 0) AS epoch FROM user_stream
WINDOW w AS (PARTITION BY campaign_id ORDER BY sequence)
""")
view("joined_members", """
SELECT m.campaign_id, e.epoch, m.consumer_id, min(m.sequence) AS since
FROM stream_members m JOIN stream_epochs e USING (campaign_id, sequence) GROUP BY 1, 2, 3
""")
view("effective", """
SELECT m.campaign_id, e.epoch, m.consumer_id, m.sequence, m.event_type, m.event_id, m.occurred_at, m.disposition, true AS member
FROM stream_members m JOIN stream_epochs e USING (campaign_id, sequence)
JOIN joined_members j ON j.campaign_id = m.campaign_id AND j.epoch = e.epoch AND j.consumer_id = m.consumer_id AND j.since = m.sequence
UNION ALL
SELECT c.campaign_id, e.epoch, c.consumer_id, c.sequence, c.event_type, c.event_id, c.occurred_at, c.disposition, false
FROM stream_changes c JOIN stream_epochs e USING (campaign_id, sequence)
JOIN joined_members j ON j.campaign_id = c.campaign_id AND j.epoch = e.epoch AND j.consumer_id = c.consumer_id AND j.since < c.sequence
""")
view("present_consumers", """
SELECT campaign_id, consumer_id, arg_max(disposition, sequence) AS disposition,
       arg_max('r' || event_id, sequence) FILTER (WHERE event_type = 'RECEIPT_ACCEPTED') AS receipt_digest, min(sequence) AS added_at
FROM effective SEMI JOIN (SELECT campaign_id, max(epoch) AS epoch FROM stream_epochs GROUP BY 1) USING (campaign_id, epoch) GROUP BY 1, 2
""")
view("consumer_failures", f"""
SELECT campaign_id, sequence, 1 AS chk, consumer_id, '' AS from_disposition, disposition AS to_disposition,
       'POLICY_ILLEGAL_CONSUMER_TRANSITION' AS refusal_code FROM stream_members
WHERE event_type <> 'RECONCILIATION_RECORDED' AND disposition NOT IN ('DISCOVERED', 'IDENTIFIED', 'OPAQUE', 'UNRESOLVED')
UNION ALL
SELECT c.campaign_id, c.sequence, 2, c.consumer_id, '', c.disposition, 'IDENTITY_NOT_FOUND' FROM stream_changes c
ANTI JOIN effective f ON f.campaign_id = c.campaign_id AND f.sequence = c.sequence AND f.consumer_id = c.consumer_id
UNION ALL
SELECT campaign_id, sequence, 3, consumer_id, prior, disposition, 'POLICY_ILLEGAL_CONSUMER_TRANSITION'
FROM (SELECT *, lag(disposition) OVER (PARTITION BY campaign_id, epoch, consumer_id ORDER BY sequence) AS prior FROM effective)
WHERE NOT member AND ((event_type = 'CONSUMER_DISPOSITION_CHANGED' AND disposition IN ('VALIDATED', 'REMOVED', 'NOT_APPLICABLE', 'WAIVED'))
      OR prior || '>' || disposition NOT IN ({", ".join(f"'{x}'" for x in pairs(CONSUMER_MOVES))}))
""")


def _states_view(stream: str) -> str:
    return f"""
SELECT *, CASE event_type WHEN 'CAMPAIGN_CREATED' THEN 'PROPOSED' WHEN 'INVENTORY_RECORDED' THEN 'INVENTORIED'
  WHEN 'MIGRATION_STARTED' THEN 'MIGRATING' WHEN 'RECONCILIATION_RECORDED' THEN 'RECONCILING'
  WHEN 'POLICY_EVALUATED' THEN CASE WHEN event_id % 3 = 2 THEN 'READY' ELSE 'BLOCKED' END WHEN 'CAMPAIGN_BLOCKED' THEN 'BLOCKED'
  WHEN 'CAMPAIGN_RESUMED' THEN ['INVENTORIED', 'MIGRATING', 'RECONCILING'][event_id // 4 % 3 + 1]
  WHEN 'CAMPAIGN_RETIRED' THEN 'RETIRED' END AS to_state FROM {stream}
"""


view("daily_states", _states_view("daily_stream"))
view("user_states", _states_view("user_stream"))
view("daily_moves", f"""
SELECT * FROM (SELECT *, lag(to_state IGNORE NULLS) OVER (PARTITION BY campaign_id ORDER BY sequence) AS from_state FROM daily_states)
WHERE event_type <> 'CAMPAIGN_CREATED' AND CASE
  WHEN event_type = 'INVENTORY_EXTENDED' THEN from_state NOT IN ('INVENTORIED', 'MIGRATING', 'BLOCKED')
  WHEN event_type = 'INVENTORY_RECORDED' AND from_state = 'INVENTORIED' THEN false
  WHEN to_state IS NULL THEN false
  ELSE from_state || '>' || to_state NOT IN ({", ".join(f"'{x}'" for x in pairs(CAMPAIGN_MOVES))}) END
""")


def _fold_view(states: str) -> str:
    return f"""
SELECT campaign_id, arg_max(to_state, sequence) FILTER (WHERE to_state IS NOT NULL) AS state, max(occurred_at) AS last_at, count(*) AS events,
       coalesce(arg_max(event_type = 'RECONCILIATION_RECORDED', sequence) FILTER (WHERE snapshot), false) AS reconciled,
       arg_max(event_id, sequence) FILTER (WHERE snapshot) AS envelope_event,
       count(*) FILTER (WHERE snapshot) AS snapshots, count(*) FILTER (WHERE event_type = 'RECEIPT_ACCEPTED') AS receipts,
       arg_max({_DIGEST_SQL}, sequence) AS head_digest
FROM (SELECT *, event_type IN ('INVENTORY_RECORDED', 'INVENTORY_EXTENDED', 'RECONCILIATION_RECORDED') AS snapshot FROM {states}) GROUP BY 1
"""


view("daily_fold", _fold_view("daily_states"))
view("user_fold", _fold_view("user_states"))

view("final_new", """
SELECT DISTINCT r.campaign_id, r.consumer_id FROM stream_members r
JOIN (SELECT campaign_id, max(epoch) AS epoch, max(CASE WHEN event_type = 'RECONCILIATION_RECORDED' THEN sequence END) AS recon
      FROM stream_epochs GROUP BY 1) l ON l.campaign_id = r.campaign_id AND r.sequence = l.recon AND l.recon > l.epoch
WHERE NOT EXISTS (SELECT 1 FROM stream_members i WHERE i.campaign_id = r.campaign_id AND i.consumer_id = r.consumer_id
  AND i.event_type <> 'RECONCILIATION_RECORDED' AND i.sequence >= l.epoch)
""")
view("final_blockers", """
SELECT campaign_id, consumer_id AS entry, 'POLICY_CONSUMER_' || disposition AS code, 3 AS harm FROM present_consumers
  WHERE disposition NOT IN ('VALIDATED', 'REMOVED', 'NOT_APPLICABLE', 'WAIVED', 'UNRESOLVED')
UNION ALL SELECT campaign_id, consumer_id, CASE WHEN waivers THEN 'POLICY_WAIVER_REVIEW' ELSE 'POLICY_WAIVER_FORBIDDEN' END, CASE WHEN waivers THEN 1 ELSE 2 END
  FROM present_consumers JOIN campaign_policies USING (campaign_id) WHERE disposition = 'WAIVED' AND NOT closing
UNION ALL SELECT campaign_id, consumer_id, 'IDENTITY_NOT_FOUND', 2 FROM present_consumers WHERE disposition = 'UNRESOLVED'
UNION ALL SELECT campaign_id, consumer_id, 'RECONCILIATION_NEW_CONSUMER', 3 FROM final_new
UNION ALL SELECT campaign_id, '', 'EVIDENCE_EMPTY_RESULT_UNPROVEN', 2 FROM user_fold ANTI JOIN present_consumers USING (campaign_id)
UNION ALL SELECT campaign_id, '', 'EVIDENCE_MODE_NOT_LIVE', 2 FROM user_fold JOIN campaign_policies USING (campaign_id) WHERE envelope_event % 13 = 0 AND live
UNION ALL SELECT campaign_id, CASE WHEN envelope_event IS NULL OR envelope_event % 17 = 0 THEN '' ELSE 'catalog' END,
  'EVIDENCE_REQUIRED_SOURCE_INCOMPLETE', 2 FROM user_fold
  WHERE envelope_event IS NULL OR envelope_event % 17 = 0 OR envelope_event % 5 IN (2, 4)
UNION ALL SELECT campaign_id, '', 'RECONCILIATION_REQUIRED', 2 FROM user_fold JOIN campaign_policies USING (campaign_id) WHERE NOT reconciled AND reconciliation
""")

# Every evaluation with the snapshot, inventories and consumers before it, joined back for each one.
view("evaluations", """
SELECT e.*, max(CASE WHEN event_type = 'RECONCILIATION_RECORDED' THEN sequence END) OVER w AS last_recon,
       arg_max(CASE WHEN event_type IN ('INVENTORY_RECORDED', 'INVENTORY_EXTENDED', 'RECONCILIATION_RECORDED') THEN event_id END,
               CASE WHEN event_type IN ('INVENTORY_RECORDED', 'INVENTORY_EXTENDED', 'RECONCILIATION_RECORDED') THEN sequence END) OVER w AS env,
       arg_max(event_type, CASE WHEN event_type IN ('INVENTORY_RECORDED', 'INVENTORY_EXTENDED', 'RECONCILIATION_RECORDED') THEN sequence END) OVER w AS env_type
FROM stream_epochs e WINDOW w AS (PARTITION BY campaign_id ORDER BY sequence)
QUALIFY event_type = 'POLICY_EVALUATED'
""")
view("consumers_at", """
SELECT v.campaign_id, v.sequence, f.consumer_id, arg_max(f.disposition, f.sequence) AS disposition,
       arg_max(f.event_id, f.sequence) FILTER (WHERE f.event_type = 'RECEIPT_ACCEPTED') AS receipt_event,
       arg_max(f.occurred_at, f.sequence) FILTER (WHERE f.event_type = 'RECEIPT_ACCEPTED') AS receipt_at, any_value(v.occurred_at) AS now
FROM evaluations v JOIN effective f ON f.campaign_id = v.campaign_id AND f.epoch = v.epoch AND f.sequence < v.sequence GROUP BY 1, 2, 3
""")
view("new_at", """
SELECT v.campaign_id, v.sequence, count(DISTINCT r.consumer_id) AS added
FROM evaluations v JOIN stream_members r ON r.campaign_id = v.campaign_id AND r.sequence = v.last_recon AND v.last_recon > v.epoch
WHERE NOT EXISTS (SELECT 1 FROM stream_members i WHERE i.campaign_id = v.campaign_id AND i.consumer_id = r.consumer_id
  AND i.event_type <> 'RECONCILIATION_RECORDED' AND i.sequence >= v.epoch AND i.sequence < v.sequence)
GROUP BY 1, 2
""")
view("codes_at", f"""
SELECT campaign_id, sequence, code, count(*) AS n, max(harm) AS harm FROM (
  SELECT campaign_id, sequence, 'POLICY_CONSUMER_' || disposition AS code, 3 AS harm FROM consumers_at
    WHERE disposition NOT IN ('VALIDATED', 'REMOVED', 'NOT_APPLICABLE', 'WAIVED', 'UNRESOLVED')
  UNION ALL SELECT campaign_id, sequence, CASE WHEN waivers THEN 'POLICY_WAIVER_REVIEW' ELSE 'POLICY_WAIVER_FORBIDDEN' END, CASE WHEN waivers THEN 1 ELSE 2 END
    FROM consumers_at JOIN campaign_policies USING (campaign_id) WHERE disposition = 'WAIVED' AND NOT closing
  UNION ALL SELECT campaign_id, sequence, 'IDENTITY_NOT_FOUND', 2 FROM consumers_at WHERE disposition = 'UNRESOLVED'
  UNION ALL SELECT campaign_id, sequence, 'EVIDENCE_RECEIPT_EXPIRED', 2 FROM consumers_at
    WHERE receipt_event IS NOT NULL AND receipt_event % 7 <> 0 AND receipt_at + to_days(CAST(receipt_event % 5 AS INT)) <= now
  UNION ALL SELECT campaign_id, sequence, 'RECONCILIATION_NEW_CONSUMER', 3 FROM new_at, range(added)
  UNION ALL SELECT v.campaign_id, v.sequence, 'EVIDENCE_EMPTY_RESULT_UNPROVEN', 2 FROM evaluations v
    WHERE NOT EXISTS (SELECT 1 FROM consumers_at c WHERE c.campaign_id = v.campaign_id AND c.sequence = v.sequence)
  UNION ALL SELECT campaign_id, sequence, 'EVIDENCE_MODE_NOT_LIVE', 2 FROM evaluations JOIN campaign_policies USING (campaign_id) WHERE env % 13 = 0 AND live
  UNION ALL SELECT campaign_id, sequence, 'EVIDENCE_REQUIRED_SOURCE_INCOMPLETE', 2 FROM evaluations
    WHERE env IS NULL OR env % 17 = 0 OR env % 5 IN (2, 4)
  UNION ALL SELECT campaign_id, sequence, 'RECONCILIATION_REQUIRED', 2 FROM evaluations JOIN campaign_policies USING (campaign_id)
    WHERE reconciliation AND (env IS NULL OR env_type <> 'RECONCILIATION_RECORDED')) GROUP BY 1, 2, 3
""")
view("evaluation_audit", """
SELECT v.campaign_id, v.sequence, ['BLOCKED', 'UNSAFE', 'READY_TO_RETIRE'][v.event_id % 3 + 1] AS recorded_decision,
       CASE max(harm) WHEN 3 THEN 'UNSAFE' WHEN 2 THEN 'BLOCKED' WHEN 1 THEN 'REVIEW_REQUIRED' ELSE 'READY_TO_RETIRE' END AS expected_decision,
       CASE WHEN v.event_id % 2 = 0 THEN 'EVIDENCE_EMPTY_RESULT_UNPROVEN:1,EVIDENCE_REQUIRED_SOURCE_INCOMPLETE:1,RECONCILIATION_REQUIRED:1'
            ELSE 'IDENTITY_NOT_FOUND:2,RECONCILIATION_REQUIRED:1' END AS recorded_codes,
       coalesce(string_agg(code || ':' || n, ',' ORDER BY code) FILTER (WHERE harm > 1), '') AS expected_codes, v.event_id % 6 = 0 AS drifted
FROM evaluations v LEFT JOIN codes_at USING (campaign_id, sequence) GROUP BY v.campaign_id, v.sequence, v.event_id
""")


# --- claims, caches, publications ---------------------------------------------------

def claims(t: Tables) -> DataFrame:
    return t.events.select(
        F.concat(F.lit("n"), F.col("event_id") % 997).alias("native_identity"),
        F.concat(F.lit("u"), F.col("user_id")).alias("campaign_id"),
        F.when(F.dayofmonth("ts") > 5, F.col("ts")).alias("released_at"))


def cache(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A cached manifest per daily campaign: one event short for every fourth user, a wrong digest or state for a few."""
    events = log(t, True)
    user = F.col("user_id")
    folded = ev.campaign_state(events).select("campaign_id", "state", "events")
    history = events.join(folded.select("campaign_id", "events"), "campaign_id").filter(
        F.col("sequence") <= F.col("events") - F.when(user % 4 == 0, 1).otherwise(0)
    ).select(
        "campaign_id", F.col("sequence").alias("position"),
        F.when((user % 17 == 0) & (F.col("sequence") == 1), F.lit("altered")).otherwise(F.col("event_digest")).alias("event_digest"))
    user_of = F.regexp_extract("campaign_id", r"^u(\d+)", 1).cast("bigint")
    stored = folded.select(
        "campaign_id",
        F.when(user_of % 19 == 0, F.lit("PROPOSED")).otherwise(F.col("state")).alias("state"),
        F.when(user_of % 23 == 0, F.lit("RETIRED")).when(user_of % 19 == 0, F.lit("PROPOSED")).otherwise(F.col("state")).alias("recorded_state"))
    return stored, history, events


def ledger(t: Tables) -> DataFrame:
    """Log rows with their event as JSON; a few disagree with their columns."""
    row = log(t, False)
    stored = F.to_json(F.struct(
        F.when(eid() % 71 == 0, F.col("sequence") + 5).otherwise(F.col("sequence")).alias("sequence"),
        F.when(eid() % 73 == 0, F.lit("CAMPAIGN_RETIRED")).otherwise(F.col("event_type")).alias("event_type"),
        "idempotency_key",
        F.when(eid() % 79 == 0, F.lit("x")).otherwise(F.col("event_digest")).alias("event_digest")))
    return row.withColumn("event_json", stored)


def signed_records(t: Tables) -> DataFrame:
    """Conversations as signed JSON texts; every seventeenth turn was altered after signing."""
    body = F.to_json(F.struct("conv_id", "role", "text", "turn"))
    signed = F.concat(F.lit("sha256:"), F.sha2(body, 256))
    turn = F.when((F.col("conv_id") + F.col("turn")) % 17 == 0, F.col("turn") + 1).otherwise(F.col("turn"))
    raw = F.to_json(F.struct(signed.alias("record_digest"), turn.alias("turn"), "text", "role", "conv_id"))
    return t.conversations.select("conv_id", "turn", raw.alias("raw"))


def publications(t: Tables) -> DataFrame:
    """Events of each user in pairs: a publication and its read-back, some altered."""
    bought = t.events.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("campaign_id"), "event_id", "user_id", F.col("ts").cast("timestamp").alias("at"))
    placed = sliced_numbers(bought, ["campaign_id"], ["at", "event_id"], "sequence", position=F.unix_micros("at"), bits=TIME_BITS)
    publishes = F.col("sequence") % 2 == 1
    carried = sliced_before(placed, ["campaign_id"], ["sequence"], last={"published": F.when(publishes, eid())})
    source = F.when(publishes, eid()).otherwise(F.col("published"))
    return carried.select(
        "campaign_id", "sequence",
        F.when(publishes, "PUBLICATION_RECORDED").otherwise("PUBLICATION_VERIFIED").alias("event_type"),
        F.when((F.col("user_id") % 9 == 0) & (F.col("sequence") == 5), F.lit("other")).otherwise(F.lit("key")).alias("logical_key"),
        F.when(eid() % 29 == 0, F.lit("moved")).otherwise(F.concat(F.lit("urn-"), F.col("user_id"))).alias("urn"),
        F.when(~publishes & (eid() % 19 == 0), F.lit("changed")).otherwise(F.concat(F.lit("d"), source % 3)).alias("content_digest"),
        F.concat(F.lit("l"), source % 5).alias("lifecycle_digest"))


view("published", """
SELECT campaign_id, sequence, CASE WHEN pub THEN 'PUBLICATION_RECORDED' ELSE 'PUBLICATION_VERIFIED' END AS event_type,
       CASE WHEN user_id % 9 = 0 AND sequence = 5 THEN 'other' ELSE 'key' END AS logical_key,
       CASE WHEN event_id % 29 = 0 THEN 'moved' ELSE 'urn-' || user_id END AS urn,
       CASE WHEN NOT pub AND event_id % 19 = 0 THEN 'changed' ELSE 'd' || src % 3 END AS content_digest, 'l' || src % 5 AS lifecycle_digest
FROM (SELECT *, CASE WHEN pub THEN event_id ELSE lag(event_id) OVER (PARTITION BY campaign_id ORDER BY sequence) END AS src
      FROM (SELECT *, sequence % 2 = 1 AS pub FROM (
        SELECT 'u' || user_id AS campaign_id, event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence
        FROM events)))
""")

_Q = lambda build: (lambda spark, folder: build(Tables(spark, folder)))


def _time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


QUERIES = {
    "e1_stream_audit": _Q(lambda t: ev.stream_audit(damaged_chain(t), stream_campaigns(t))),
    "e2_idempotent_dedupe": _Q(lambda t: ev.idempotent_dedupe(arrivals(t)).select(
        "campaign_id", "idempotency_key", "arrivals", "sequence", "refusal_code")),
    "e3_campaign_transitions": _Q(lambda t: ev.campaign_transitions(log(t, True))),
    "e4_consumer_transitions": _Q(lambda t: ev.consumer_transitions(log(t, False))),
    "e5_campaign_state": _Q(lambda t: _state_row(ev.campaign_state(log(t, True)))),
    "e5_snapshot_delta": _Q(lambda t: _state_row(ev.finish_fold(ev.continue_fold(*snapshot_and_delta(t))))),
    "e6_consumer_state": _Q(lambda t: ev.consumer_state(ev.annotate(log(t, False)))),
    "e6_new_consumer_state": _Q(lambda t: ev.new_consumer_state(ev.annotate(log(t, False)))),
    "e7_manifest": _Q(lambda t: r.manifest(log(t, False)).select(
        "campaign_id", "state", "decision", "events", "snapshots", "receipts", "blockers", "consumers", "closed", "head_digest",
        F.coalesce("evidence_mode", F.lit("")).alias("evidence_mode"), "consumer_hash", "envelope_digest", "manifest_digest")),
    "e7_manifest_entries": _Q(lambda t: r.manifest_entries(log(t, False))),
    "e8_stream_digest": _Q(lambda t: ev.stream_digest(log(t, False), width=16, levels=3)),
    "e9_digest_verify": _Q(lambda t: ev.digest_verify(signed_records(t), "raw", "record_digest").select("conv_id", "turn", "digest_valid")),
    "e10_materialised_audit": _Q(lambda t: ev.materialised_audit(*cache(t))),
    "e10_ledger_column_audit": _Q(lambda t: ev.ledger_column_audit(ledger(t))),
    "e11_identity_overlap": _Q(lambda t: ev.identity_overlap(claims(t))),
    "e12_publication_audit": _Q(lambda t: ev.publication_audit(publications(t))),
    "e13_state_at_publication": _Q(lambda t: ev.state_at_publication(
        log(t, False), base_stream(t, False).select(
            "campaign_id", "sequence", F.concat(F.lit("d"), eid() % 3).alias("content_digest")))),
    "e15_policy_event_audit": _Q(lambda t: ev.policy_event_audit(log(t, False))),
}

view("consumer_hashes", """
SELECT campaign_id, bit_xor(CAST('0x' || substr(sha256(length(consumer_id) || ':' || consumer_id || length(disposition) || ':' || disposition
         || coalesce(length(receipt_digest) || ':' || receipt_digest, '~')), 1, 15) AS BIGINT)) AS h FROM present_consumers GROUP BY 1
""")
view("manifest_heads", f"""
SELECT f.campaign_id, f.state, CASE max(b.harm) WHEN 3 THEN 'UNSAFE' WHEN 2 THEN 'BLOCKED' WHEN 1 THEN 'REVIEW_REQUIRED' ELSE 'READY_TO_RETIRE' END AS decision,
       any_value(f.events) AS events, any_value(f.snapshots) AS snapshots, any_value(f.receipts) AS receipts, count(b.code) FILTER (WHERE b.harm > 1) AS blockers,
       coalesce(any_value(c.n), 0) AS consumers, coalesce(any_value(c.closed), 0) AS closed, any_value(f.head_digest) AS head_digest,
       CASE WHEN any_value(f.envelope_event) IS NULL THEN '' WHEN any_value(f.envelope_event) % 13 = 0 THEN 'replay' ELSE 'live' END AS evidence_mode,
       coalesce(any_value(h.h), 0) AS consumer_hash,
       'sha256:' || sha256(coalesce('{{"mode":"' || CASE WHEN any_value(f.envelope_event) % 13 = 0 THEN 'replay' ELSE 'live' END
         || '","sources":[{{"id":"catalog","required":' || CASE WHEN any_value(f.envelope_event) % 17 <> 0 THEN 'true' ELSE 'false' END
         || ',"status":"' || {_sql_list(STATUSES)}[any_value(f.envelope_event) % 5 + 1] || '"}}]}}', '{{}}')) AS envelope_digest
FROM user_fold f LEFT JOIN final_blockers b USING (campaign_id) LEFT JOIN consumer_hashes h USING (campaign_id)
LEFT JOIN (SELECT campaign_id, count(*) AS n, count(*) FILTER (WHERE disposition IN ('VALIDATED', 'REMOVED', 'NOT_APPLICABLE')) AS closed
           FROM present_consumers GROUP BY 1) c USING (campaign_id)
GROUP BY f.campaign_id, f.state
""")
view("manifest_rows", """
SELECT *, 'sha256:' || sha256(concat_ws('|', campaign_id, state, decision, head_digest, consumer_hash, envelope_digest)) AS manifest_digest FROM manifest_heads
""")
_STATE_SQL = """
SELECT campaign_id, state, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_event_at, events, reconciled,
       CASE WHEN envelope_event IS NULL THEN '' WHEN envelope_event % 13 = 0 THEN 'replay' ELSE 'live' END AS mode, snapshots, receipts, head_digest
FROM {}"""

ORACLES = {
    "e1_stream_audit": twin("""
SELECT c.campaign_id, coalesce(a.events, 0) AS events,
       CASE WHEN a.events IS NULL THEN 'INTEGRITY_EVENT_SEQUENCE_INVALID' WHEN f.code IS NOT NULL THEN f.code
            WHEN a.first_type <> 'CAMPAIGN_CREATED' THEN 'INTEGRITY_EVENT_SEQUENCE_INVALID' END AS refusal_code,
       CASE WHEN a.events IS NULL THEN 0 WHEN f.code IS NOT NULL THEN f.failed_seq WHEN a.first_type <> 'CAMPAIGN_CREATED' THEN 1 ELSE 0 END AS failed_at
FROM (SELECT DISTINCT 'u' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS campaign_id FROM events
      UNION SELECT DISTINCT 'u' || user_id || '-silent' FROM events) c
LEFT JOIN (SELECT campaign_id, count(*) AS events, arg_min(event_type, sequence) AS first_type FROM damaged GROUP BY 1) a USING (campaign_id)
LEFT JOIN (SELECT campaign_id, arg_min(code, expected) AS code, arg_min(failed_seq, expected) AS failed_seq FROM audit_codes WHERE code IS NOT NULL GROUP BY 1) f
  USING (campaign_id)"""),
    "e2_idempotent_dedupe": twin("""
SELECT campaign_id, 'e' || event_id AS idempotency_key, sequence,
       CAST(1 + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 47 = 0 THEN 1 ELSE 0 END AS BIGINT) AS arrivals,
       CASE WHEN event_id % 47 = 0 THEN 'INTEGRITY_IDEMPOTENCY_CONFLICT' END AS refusal_code FROM daily_stream"""),
    "e3_campaign_transitions": twin("""
SELECT campaign_id, sequence, event_type, from_state, to_state, 'POLICY_ILLEGAL_CAMPAIGN_TRANSITION' AS refusal_code FROM daily_moves
QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY sequence) = 1"""),
    "e4_consumer_transitions": twin("""
SELECT campaign_id, sequence, consumer_id, from_disposition, to_disposition, refusal_code FROM consumer_failures
QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY sequence, chk, consumer_id) = 1"""),
    "e5_campaign_state": twin(_STATE_SQL.format("daily_fold")),
    "e5_snapshot_delta": twin(_STATE_SQL.format("user_fold")),
    "e6_consumer_state": twin("SELECT * FROM present_consumers"),
    "e6_new_consumer_state": twin("SELECT * FROM final_new"),
    "e7_manifest": twin("SELECT * FROM manifest_rows"),
    "e7_manifest_entries": twin("""
SELECT campaign_id, 'consumer' AS section, consumer_id AS entry, disposition AS value FROM present_consumers
UNION ALL SELECT campaign_id, 'blocker', entry, code FROM final_blockers
UNION ALL SELECT campaign_id, 'history', CAST(sequence AS VARCHAR), event_type FROM user_stream"""),
    "e8_stream_digest": twin("""
SELECT campaign_id, sha256(string_agg(d, ',' ORDER BY n)) AS stream_digest FROM (
  SELECT campaign_id, n // 16 AS g, n // 16 AS n, sha256(string_agg(d, ',' ORDER BY n)) AS d FROM (
    SELECT campaign_id, n // 16 AS n, sha256(string_agg(d, ',' ORDER BY n)) AS d FROM (
      SELECT campaign_id, sequence AS n, sha256(campaign_id || '|' || sequence || '|' || event_id || '|' || event_type) AS d FROM user_stream)
    GROUP BY 1, 2) GROUP BY 1, 2, 3) GROUP BY campaign_id, g // 16"""),
    "e9_digest_verify": "SELECT conv_id, turn, (conv_id + turn) % 17 <> 0 AS digest_valid FROM conversations",
    "e10_materialised_audit": twin("""
SELECT campaign_id, cached_events, log_events, finding, CASE WHEN finding IS NOT NULL THEN 'INTEGRITY_MATERIALIZED_STATE_MISMATCH' END AS refusal_code
FROM (SELECT campaign_id, log_events, cached_events,
        CASE WHEN user_id % 17 = 0 AND cached_events > 0 THEN 'NOT_A_REPLAY_PREFIX'
             WHEN cached_events = log_events AND user_id % 19 = 0 AND state <> 'PROPOSED' THEN 'REPLAY_DIFFERS'
             WHEN user_id % 23 = 0 AND CASE WHEN user_id % 19 = 0 THEN 'PROPOSED' ELSE state END <> 'RETIRED' THEN 'RECORDED_STATE_DIFFERS' END AS finding
      FROM (SELECT campaign_id, state, events AS log_events, CAST(regexp_extract(campaign_id, '^u(\\d+)', 1) AS BIGINT) AS user_id,
                   CASE WHEN CAST(regexp_extract(campaign_id, '^u(\\d+)', 1) AS BIGINT) % 4 = 0 THEN events - 1 ELSE events END AS cached_events
            FROM daily_fold))"""),
    "e10_ledger_column_audit": twin("""
SELECT campaign_id, sequence, concat_ws(',', CASE WHEN event_id % 71 = 0 THEN 'sequence' END,
       CASE WHEN event_id % 73 = 0 AND event_type <> 'CAMPAIGN_RETIRED' THEN 'event_type' END,
       CASE WHEN event_id % 79 = 0 THEN 'event_digest' END) AS wrong_columns FROM user_stream
WHERE event_id % 71 = 0 OR (event_id % 73 = 0 AND event_type <> 'CAMPAIGN_RETIRED') OR event_id % 79 = 0"""),
    "e11_identity_overlap": """
SELECT 'n' || event_id % 997 AS native_identity, count(DISTINCT user_id) AS campaigns, 'SOURCE_CONSUMER_OVERLAP' AS refusal_code
FROM events WHERE day(ts) <= 5 GROUP BY 1 HAVING count(DISTINCT user_id) > 1""",
    "e12_publication_audit": twin("""
SELECT campaign_id, sequence, event_type, refusal_code FROM (
  SELECT p.*, CASE
    WHEN p.event_type = 'PUBLICATION_RECORDED' AND b.urn IS NOT NULL AND (p.logical_key <> b.logical_key OR p.urn <> b.urn) THEN 'INTEGRITY_DIGEST_MISMATCH'
    WHEN p.event_type = 'PUBLICATION_VERIFIED' AND (p.urn <> b.urn OR p.content_digest <> b.content_digest OR p.lifecycle_digest <> b.lifecycle_digest)
      THEN 'EVIDENCE_PUBLICATION_MISMATCH' END AS refusal_code
  FROM published p LEFT JOIN published b ON b.campaign_id = p.campaign_id AND b.event_type = 'PUBLICATION_RECORDED'
    AND b.sequence = p.sequence - CASE WHEN p.event_type = 'PUBLICATION_RECORDED' THEN 2 ELSE 1 END)
WHERE refusal_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY sequence) = 1"""),
    "e13_state_at_publication": twin("""
SELECT campaign_id, 'd' || event_id % 3 AS content_digest, sequence, before AS state_before FROM (
  SELECT *, lag(to_state IGNORE NULLS) OVER (PARTITION BY campaign_id ORDER BY sequence) AS before FROM user_states)
QUALIFY row_number() OVER (PARTITION BY campaign_id, event_id % 3 ORDER BY sequence DESC) = 1"""),
    "e15_policy_event_audit": twin("""
SELECT campaign_id, sequence, recorded_decision, expected_decision, recorded_codes, expected_codes,
       CASE WHEN drifted THEN 'POLICY_INPUT_DRIFT' WHEN recorded_decision <> expected_decision OR recorded_codes <> expected_codes
            THEN 'POLICY_EVENT_DECISION_MISMATCH' END AS refusal_code FROM evaluation_audit"""),
}
