import hashlib
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sundown.operators import events as ev
from sundown.operators import report as r
from sundown.vocabulary import CAMPAIGN_MOVES, CAMPAIGN_STATES, CONSUMER_MOVES, DISPOSITIONS, pairs

LOG = ("campaign_id string, sequence bigint, event_type string, occurred_at timestamp, idempotency_key string, "
       "previous_event_digest string, event_digest string, payload string")
ENVELOPE = {"mode": "live", "sources": [{"id": "s", "required": True, "status": "COMPLETE"}]}
INPUTS = {"input_digests": {"policy": "1"}}


def members(**consumers):
    return [{"id": i, "disposition": d} for i, d in consumers.items()]


def inventory(kind="INVENTORY_RECORDED", **consumers):
    return kind, {"consumers": members(**consumers), "evidence_envelope": ENVELOPE}


def reconciled(**consumers):
    return "RECONCILIATION_RECORDED", {"consumers": members(**consumers), "consumer_ids": list(consumers), "evidence_envelope": ENVELOPE}


def change(consumer, disposition):
    return "CONSUMER_DISPOSITION_CHANGED", {"consumer_id": consumer, "disposition": disposition}


def receipt(consumer, expires=None):
    return "RECEIPT_ACCEPTED", {"consumer_id": consumer, "receipt": {"receipt_digest": f"r-{consumer}", "expires_at": expires}}


def evaluated(decision, *codes, inputs=INPUTS):
    return "POLICY_EVALUATED", {"decision": decision, "blocker_codes": list(codes), **inputs}


CREATED = ("CAMPAIGN_CREATED", INPUTS)
START = ("MIGRATION_STARTED", {})


def log_rows(campaign, events):
    rows, before = [], None
    for n, (kind, payload) in enumerate(events, 1):
        digest = f"{campaign}-{n}"
        at = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=n)
        rows.append((campaign, n, kind, at, f"k{n}", before, digest, json.dumps(payload)))
        before = digest
    return rows


@pytest.fixture
def logs(spark):
    """One log holding every named campaign."""
    return lambda campaigns: spark.createDataFrame([r for name, events in campaigns.items() for r in log_rows(name, events)], LOG)


@pytest.fixture
def log(logs):
    return lambda *events, campaign="c": logs({campaign: events})


READY = (CREATED, inventory(a="IDENTIFIED"), START, change("a", "CHANGE_PROPOSED"), change("a", "APPLIED"), receipt("a"),
         reconciled(a="OPAQUE"), evaluated("READY_TO_RETIRE"))


def audit(log, campaigns):
    row = ev.stream_audit(log, campaigns).first()
    return row["refusal_code"], row["failed_at"]


def test_stream_audit(log, make):
    one = make("campaign_id string", ("c",))
    good = log(*READY)
    assert audit(good, one) == (None, 0)
    assert audit(good.filter("false"), one) == ("INTEGRITY_EVENT_SEQUENCE_INVALID", 0)
    assert audit(good.filter("sequence <> 3"), one) == ("INTEGRITY_EVENT_SEQUENCE_INVALID", 4)
    assert audit(good.filter("sequence > 1"), one) == ("INTEGRITY_EVENT_SEQUENCE_INVALID", 2)
    assert audit(good.withColumn("previous_event_digest", F.when(F.col("sequence") == 5, "x").otherwise(F.col("previous_event_digest"))), one) == (
        "INTEGRITY_EVENT_CHAIN_MISMATCH", 5)
    assert audit(good.withColumn("occurred_at", F.when(F.col("sequence") == 6, F.lit("2023-01-01").cast("timestamp")).otherwise(F.col("occurred_at"))), one) == (
        "RUNTIME_CLOCK_ROLLBACK", 6)
    assert audit(good.withColumn("occurred_at", F.lit("2023-01-01").cast("timestamp")), one) == (None, 0), "equal times are fine"
    assert audit(log(START, START), one) == ("INTEGRITY_EVENT_SEQUENCE_INVALID", 1)
    assert audit(good.union(good.filter("sequence = 4")), one)[0] == "INTEGRITY_EVENT_SEQUENCE_INVALID"


def test_dedupe(log, got):
    base = log(CREATED, START)
    again = base.union(base.filter("sequence = 2")).union(base.filter("sequence = 1").withColumn("payload", F.lit("{}")))
    assert got(ev.idempotent_dedupe(again), "idempotency_key", "arrivals", "refusal_code") == [
        ("k1", 2, "INTEGRITY_IDEMPOTENCY_CONFLICT"), ("k2", 2, None)]


REACH = {  # legal ways into each state
    "PROPOSED": (CREATED,), "INVENTORIED": (CREATED, inventory(a="OPAQUE")), "MIGRATING": (CREATED, inventory(a="OPAQUE"), START),
    "RECONCILING": (CREATED, inventory(a="OPAQUE"), reconciled(a="OPAQUE")), "BLOCKED": (CREATED, ("CAMPAIGN_BLOCKED", {})),
    "READY": (CREATED, inventory(a="OPAQUE"), reconciled(a="OPAQUE"), evaluated("READY_TO_RETIRE")),
    "RETIRED": (CREATED, inventory(a="OPAQUE"), reconciled(a="OPAQUE"), evaluated("READY_TO_RETIRE"), ("CAMPAIGN_RETIRED", {})),
}


def test_every_campaign_move(logs):
    every = logs({
        f"{start}>{end}": (*way, ("CAMPAIGN_RESUMED", {"state": end})) for start, way in REACH.items() for end in CAMPAIGN_STATES})
    illegal = {r["campaign_id"] for r in ev.campaign_transitions(every, chunk_rows=2).collect()}
    expected = {f"{a}>{b}" for a in CAMPAIGN_STATES for b in CAMPAIGN_STATES} - set(pairs(CAMPAIGN_MOVES))
    assert illegal == expected


def test_inventory_rules(logs, got):
    both = logs({"twice": (CREATED, inventory(a="OPAQUE"), inventory(a="OPAQUE")), "early": (CREATED, inventory("INVENTORY_EXTENDED", a="OPAQUE"))})
    assert got(ev.campaign_transitions(both), "campaign_id", "sequence") == [("early", 2)]


def test_every_consumer_move(logs):
    """From every disposition a reconciliation can give, through one change event."""
    every = logs({
        f"{start}>{end}": (CREATED, inventory(), reconciled(a=start), change("a", end)) for start in DISPOSITIONS for end in DISPOSITIONS})
    expected = {
        f"{start}>{end}" for start in DISPOSITIONS for end in DISPOSITIONS
        if end in ("VALIDATED", "REMOVED", "NOT_APPLICABLE", "WAIVED") or end not in CONSUMER_MOVES[start]}
    assert {r["campaign_id"] for r in ev.consumer_transitions(every, chunk_rows=2).collect()} == expected


def test_consumer_failures(logs, got):
    every = logs({
        "import": (CREATED, inventory(a="VALIDATED")),
        "unknown": (CREATED, inventory(a="OPAQUE"), change("b", "STALE")),
        "double": (CREATED, ("INVENTORY_RECORDED", {"consumers": members(a="OPAQUE") * 2})),
        "reset": (CREATED, inventory(a="IDENTIFIED"), change("a", "STALE"), inventory(a="IDENTIFIED"), change("a", "STALE")),
        "waived": (CREATED, inventory(a="OPAQUE"), ("WAIVER_RECORDED", {"waiver": {"consumer_id": "a"}})),
        "receipt": (CREATED, inventory(a="OPAQUE"), receipt("a")),
    })
    assert got(ev.consumer_transitions(every), "campaign_id", "sequence", "refusal_code") == [
        ("double", 2, "IDENTITY_AMBIGUOUS"), ("import", 2, "POLICY_ILLEGAL_CONSUMER_TRANSITION"),
        ("receipt", 3, "POLICY_ILLEGAL_CONSUMER_TRANSITION"), ("unknown", 3, "IDENTITY_NOT_FOUND")]


def test_folds(log, got):
    ready = log(*READY)
    row = ev.campaign_state(ready).first()
    assert (row["state"], row["events"], row["reconciled"], row["head_digest"]) == ("READY", 8, True, "c-8")
    assert got(ev.consumer_state(ev.annotate(ready, 2), 2), "consumer_id", "disposition", "receipt_digest") == [("a", "VALIDATED", "r-a")]
    extended = log(CREATED, inventory(a="OPAQUE", b="OPAQUE"), inventory("INVENTORY_EXTENDED", b="IDENTIFIED", d="IDENTIFIED"), reconciled(a="OPAQUE", z="DISCOVERED"))
    annotated = ev.annotate(extended, 2)
    assert got(ev.consumer_state(annotated), "consumer_id", "disposition") == [("a", "OPAQUE"), ("b", "OPAQUE"), ("d", "IDENTIFIED"), ("z", "DISCOVERED")]
    assert got(ev.new_consumer_state(annotated), "consumer_id") == [("z",)]
    replaced = log(CREATED, inventory(a="OPAQUE"), inventory(b="OPAQUE"))
    assert got(ev.consumer_state(ev.annotate(replaced)), "consumer_id") == [("b",)]
    manifest = r.manifest(ready).first()
    assert (manifest["decision"], manifest["consumers"], manifest["closed"]) == ("READY_TO_RETIRE", 1, 1)
    assert r.manifest_entries(ready).groupBy("section").count().count() == 2, "no blockers"


def test_policy_event_audit(logs, got):
    late = (CREATED, inventory(a="IDENTIFIED"), START, change("a", "CHANGE_PROPOSED"), change("a", "APPLIED"), receipt("a"), reconciled(a="OPAQUE", z="DISCOVERED"),
            evaluated("UNSAFE", "POLICY_CONSUMER_DISCOVERED", "RECONCILIATION_NEW_CONSUMER"), inventory("INVENTORY_EXTENDED", z="DISCOVERED"),
            evaluated("UNSAFE", "POLICY_CONSUMER_DISCOVERED", "RECONCILIATION_REQUIRED"))
    expiring = (*READY[:5], receipt("a", "2024-01-01T08:30:00Z"), reconciled(a="OPAQUE"), evaluated("READY_TO_RETIRE"), reconciled(a="OPAQUE"),
                evaluated("BLOCKED", "EVIDENCE_RECEIPT_EXPIRED"))
    replaced = (*READY[:5], receipt("a", "2024-01-01T08:30:00Z"), change("a", "STALE"), change("a", "CHANGE_PROPOSED"), receipt("a", "2025-01-01T00:00:00Z"),
                reconciled(a="OPAQUE"), evaluated("READY_TO_RETIRE"))
    drifted = (*READY[:-1], evaluated("READY_TO_RETIRE", inputs={"input_digests": {"policy": "2"}}))
    wrong = (*READY[:-1], evaluated("READY_TO_RETIRE", "RECONCILIATION_REQUIRED"))
    every = logs({"ready": READY, "late": late, "expiring": expiring, "replaced": replaced, "drifted": drifted, "wrong": wrong})
    result = got(ev.policy_event_audit(every, chunk_rows=3), "campaign_id", "sequence", "refusal_code")
    assert result == [
        ("drifted", 8, "POLICY_INPUT_DRIFT"), ("expiring", 10, None), ("expiring", 8, None), ("late", 10, None), ("late", 8, None),
        ("ready", 8, None), ("replaced", 11, None), ("wrong", 8, "POLICY_EVENT_DECISION_MISMATCH")]


def test_digests(log, make, got):
    long = log(*[START] * 40)
    one = ev.stream_digest(long, width=4, levels=4).first()[1]
    assert one == ev.stream_digest(long.repartition(7), width=4, levels=4).first()[1]
    assert one != ev.stream_digest(long.filter("sequence < 40"), width=4, levels=4).first()[1]
    body = {"b": 10000000000.0, "a": "é\u001f", "n": [1, None]}
    digest = "sha256:" + hashlib.sha256(json.dumps(body, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
    rows = make("raw string", (json.dumps({"d": digest, **body}),), (json.dumps({"d": digest, **body, "a": "x"}),), ("{",), (None,))
    assert [r["digest_valid"] for r in ev.digest_verify(rows, "raw", "d").collect()] == [True, False, False, False]


def test_caches_claims_publications(log, make, got):
    ready = log(*READY)
    history = ready.select("campaign_id", F.col("sequence").alias("position"), "event_digest")
    cache = "campaign_id string, state string, recorded_state string"

    def finding(row, rows):
        return ev.materialised_audit(make(cache, row), rows, ready).first()["finding"]

    assert finding(("c", "READY", "READY"), history) is None
    assert finding(("c", "MIGRATING", "MIGRATING"), history.filter("position < 6")) is None, "a prefix may be behind"
    assert finding(("c", "BLOCKED", "BLOCKED"), history) == "REPLAY_DIFFERS"
    assert finding(("c", "READY", "BLOCKED"), history) == "RECORDED_STATE_DIFFERS"
    assert finding(("c", "READY", "READY"), history.withColumn("event_digest", F.lit("x"))) == "NOT_A_REPLAY_PREFIX"
    claims = make("native_identity string, campaign_id string, released_at string", ("n", "a", None), ("n", "b", None), ("m", "a", None), ("m", "b", "t"))
    assert got(ev.identity_overlap(claims), "native_identity", "campaigns") == [("n", 2)]
    pub = "campaign_id string, sequence int, event_type string, logical_key string, urn string, content_digest string, lifecycle_digest string"
    rec, ver = "PUBLICATION_RECORDED", "PUBLICATION_VERIFIED"
    rows = make(pub, ("ok", 1, rec, "k", "u", "c", "l"), ("ok", 2, ver, None, "u", "c", "l"), ("first", 1, ver, None, "u", "c", "l"),
                ("moved", 1, rec, "k", "u", "c", "l"), ("moved", 2, rec, "k", "v", "c", "l"), ("life", 1, rec, "k", "u", "c", "l"), ("life", 2, ver, None, "u", "c", "m"))
    assert got(ev.publication_audit(rows), "campaign_id", "refusal_code") == [
        ("first", "INTEGRITY_EVENT_SEQUENCE_INVALID"), ("life", "EVIDENCE_PUBLICATION_MISMATCH"), ("moved", "INTEGRITY_DIGEST_MISMATCH")]
    marks = make("campaign_id string, sequence bigint, content_digest string", ("c", 3, "d"), ("c", 8, "d"), ("c", 3, "e"))
    assert got(ev.state_at_publication(ready, marks, 3), "content_digest", "sequence", "state_before") == [("d", 8, "RECONCILING"), ("e", 3, "INVENTORIED")]


def test_a_stored_fold_continued_equals_the_whole(spark, logs, got, tmp_path):
    every = logs({"ready": READY, "early": (CREATED, inventory(a="OPAQUE")), "late": (CREATED, inventory(a="OPAQUE"), START, reconciled(a="OPAQUE"))})
    whole = ev.campaign_state(every)
    for border in range(0, 9):
        parts = [every.filter(F.col("sequence") <= border), every.filter((F.col("sequence") > border) & (F.col("sequence") <= border + 2)),
                 every.filter(F.col("sequence") > border + 2)]
        ev.campaign_fold(parts[0]).write.mode("overwrite").parquet(str(tmp_path / f"fold{border}"))
        stored = spark.read.schema(f"campaign_id string, {ev.FOLD}").parquet(str(tmp_path / f"fold{border}"))
        continued = ev.finish_fold(ev.continue_fold(ev.continue_fold(stored, parts[2]), parts[1]))
        assert got(continued, *whole.columns) == got(whole, *whole.columns)
