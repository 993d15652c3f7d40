import pytest
from pyspark.sql import functions as F

from sundown.functions.paths import inside_root
from sundown.operators import gate as g
from sundown.operators import records as r

NOW = "2024-01-01 12:00:00"


@pytest.fixture
def now(spark):
    return F.to_timestamp(F.lit(NOW))


GOOD_APPROVAL = {"recorded": 1, "digest_valid": True, "campaign_id": "c", "plan_digest": "p", "source_version": "v", "targets": ["a", "b"],
                 "scope": ["apply", "read"], "authorization_digest": "x", "authorized_at": "2024-01-01T11:00:00Z", "expires_at": "2024-01-01T12:00:01Z"}
APPROVAL = ("request_id int, recorded int, digest_valid boolean, campaign_id string, plan_digest string, source_version string, targets array<string>, "
            "scope array<string>, authorization_digest string, authorized_at string, expires_at string")
MUTATIONS = [
    ({}, None), ({"digest_valid": False}, "INTEGRITY_DIGEST_MISMATCH"), ({"campaign_id": "d"}, "AUTH_APPROVAL_WRONG_CAMPAIGN"),
    ({"plan_digest": "q"}, "AUTH_APPROVAL_WRONG_PLAN"), ({"source_version": "w"}, "AUTH_APPROVAL_WRONG_SOURCE"),
    ({"targets": ["b", "a"]}, None), ({"targets": ["a", "b", "b"]}, "AUTH_APPROVAL_WRONG_SCOPE"), ({"scope": ["read"]}, "AUTH_APPROVAL_WRONG_SCOPE"),
    ({"authorization_digest": "y"}, "AUTH_APPROVAL_WRONG_SCOPE"), ({"expires_at": "2024-01-01T12:00:00Z"}, "AUTH_APPROVAL_EXPIRED"),
    ({"authorized_at": "2024-01-01T12:00:31Z"}, "RUNTIME_CLOCK_FUTURE"), ({"authorized_at": "2024-01-01T12:00:30+00:00"}, None),
    ({"authorized_at": "2024-01-01T11:00:00"}, "RUNTIME_CLOCK_INVALID"),
    ({"campaign_id": "d", "plan_digest": "q"}, "AUTH_APPROVAL_WRONG_CAMPAIGN"),
]


def test_approvals(make, now, got):
    requests = make("request_id int, campaign_id string, plan_digest string, source_version string, targets array<string>, required_scope array<string>, "
                    "authorization_digest string, last_trusted_at timestamp", *[(i, "c", "p", "v", ["a", "b"], ["apply"], "x", None) for i in range(len(MUTATIONS) + 1)])
    given = make(APPROVAL, *[(i, *{**GOOD_APPROVAL, **m}.values()) for i, (m, _) in enumerate(MUTATIONS)], (0, *{**GOOD_APPROVAL, "recorded": 0, "campaign_id": "z"}.values()))
    codes = dict(got(r.approval_audit(requests, given, now), "request_id", "refusal_code"))
    assert [codes[i] for i in range(len(MUTATIONS))] == [c for _, c in MUTATIONS]
    assert codes[len(MUTATIONS)] == "AUTH_APPROVAL_MISSING"
    rolled = requests.withColumn("last_trusted_at", F.lit("2024-01-01 12:00:01").cast("timestamp"))
    assert dict(got(r.approval_audit(rolled, given, now), "request_id", "refusal_code"))[0] == "RUNTIME_CLOCK_ROLLBACK"


RECEIPT = {"digest_valid": True, "campaign_id": "c", "consumer_id": "k", "mode": "live", "plan_digest": "p", "approved_targets": ["a"], "proposed_targets": ["a"],
           "actual_targets": ["a"], "source_version": "v", "result": "PASSED", "terminal_disposition": "VALIDATED", "captured_at": "2024-01-01T12:00:00Z", "expires_at": None}
RECEIPT_CASES = [
    ({}, None), ({"digest_valid": False}, "INTEGRITY_DIGEST_MISMATCH"), ({"consumer_id": "x"}, "IDENTITY_NOT_FOUND"), ({"mode": "fixture"}, "EVIDENCE_RECEIPT_MODE_NOT_LIVE"),
    ({"plan_digest": "q"}, "AUTH_APPROVAL_WRONG_PLAN"), ({"actual_targets": ["a", "b"]}, "SCOPE_RECEIPT_TARGET_MISMATCH"), ({"proposed_targets": []}, "SCOPE_RECEIPT_TARGET_MISMATCH"),
    ({"source_version": "w"}, "SOURCE_RECEIPT_VERSION_MISMATCH"), ({"result": "FAILED"}, "VALIDATION_RECEIPT_FAILED"), ({"result": "SKIPPED"}, "VALIDATION_RECEIPT_INCONCLUSIVE"),
    ({"terminal_disposition": "STALE"}, "VALIDATION_RECEIPT_FAILED"), ({"expires_at": "2024-01-01T12:00:00Z"}, "EVIDENCE_RECEIPT_EXPIRED"),
]


def test_receipts(make, now, got):
    kind = ("receipt_id int, digest_valid boolean, campaign_id string, consumer_id string, mode string, plan_digest string, approved_targets array<string>, "
            "proposed_targets array<string>, actual_targets array<string>, source_version string, result string, terminal_disposition string, captured_at string, expires_at string")
    given = make(kind, *[(i, *{**RECEIPT, **m}.values()) for i, (m, _) in enumerate(RECEIPT_CASES)])
    expected = make("receipt_id int, campaign_id string, consumer_id string, plan_digest string, source_version string, approved_targets array<string>",
                    *[(i, "c", "k", "p", "v", ["a"]) for i in range(len(RECEIPT_CASES))])
    codes = dict(got(r.receipt_audit(given, expected, now), "receipt_id", "refusal_code"))
    assert [codes[i] for i in range(len(RECEIPT_CASES))] == [c for _, c in RECEIPT_CASES]


def test_waivers_and_clock(make, now, got):
    kind = ("waiver_id int, digest_valid boolean, campaign_id string, used_campaign_id string, consumer_id string, used_consumer_id string, scope array<string>, "
            "used_scope array<string>, authorized_at string, expires_at string")
    early, late = "2024-01-01T11:00:00Z", "2024-01-01T13:00:00Z"
    rows = make(kind, (1, True, "c", "c", "k", "k", ["s"], ["s"], early, late), (2, True, "c", "d", "k", "k", ["s"], ["s"], early, late),
                (3, True, "c", "c", "k", "k", ["s"], ["s", "t"], early, late), (4, True, "c", "c", "k", "k", ["s"], ["s"], early, early), (5, False, "c", "c", "k", "k", ["s"], ["s"], early, late))
    assert [c for _, c in got(r.waiver_audit(rows, now))] == [None, "AUTH_WAIVER_INVALID", "AUTH_WAIVER_INVALID", "AUTH_WAIVER_EXPIRED", "INTEGRITY_DIGEST_MISMATCH"]
    clock = make("record_id int, observed_at string, last_trusted_at string, source_clock_at string, expires_at string",
                 (1, "2024-01-01T12:00:30Z", "2024-01-01T12:00:00Z", "2024-01-01T12:05:00Z", None), (2, None, "2024-01-01T12:00:01Z", None, None),
                 (3, "2024-01-01T14:00:31+02:00", None, None, None), (4, None, None, "2024-01-01T11:54:59Z", None), (5, None, None, None, "2024-01-01T12:00:00Z"),
                 (6, "2024-02-30T00:00:00Z", None, None, None), (7, "2024-01-01", None, None, None))
    assert [c for _, c in got(r.clock_audit(clock, now))] == [
        None, "RUNTIME_CLOCK_ROLLBACK", "RUNTIME_CLOCK_FUTURE", "RUNTIME_CLOCK_SKEW", "EVIDENCE_RECEIPT_EXPIRED", "RUNTIME_CLOCK_INVALID", "RUNTIME_CLOCK_INVALID"]


@pytest.mark.parametrize("path, inside", [("a/b", "a/b"), ("a/../b", "b"), ("./a//b", "a/b"), ("../a", None), ("a/../../b", None), ("/a", None), ("a/../../r/b", None)])
def test_inside_root(make, path, inside):
    assert make("p string", (path,)).select(inside_root(F.col("p")).alias("r")).first()["r"] == inside


def test_scenarios_specs_contracts(make, got):
    kind = ("scenario_id int, evidence_required boolean, evidence_status string, identity_match_count int, replacement_compatible boolean, source_path string, expected_fingerprint string")
    base = (True, "COMPLETE", 1, True, "m/a", "f")
    rows = make(kind, (1, *base), (2, True, "PARTIAL", *base[2:]), (3, False, "PARTIAL", *base[2:]), (4, *base[:2], 0, *base[3:]), (5, *base[:2], 2, *base[3:]),
                (6, *base[:3], None, *base[4:]), (7, *base[:4], "../m/a", "f"), (8, *base[:4], "m/z", "f"), (9, *base[:4], "n/a", "f"), (10, *base[:5], "g"))
    codes = dict(got(r.scenario_precheck(rows, make("path string, fingerprint string", ("m/a", "f"), ("n/a", "f")), ["m"])))
    assert [codes[i] for i in range(1, 11)] == [
        None, "EVIDENCE_REQUIRED_SOURCE_INCOMPLETE", None, "IDENTITY_NOT_FOUND", "IDENTITY_AMBIGUOUS", "SPEC_REPLACEMENT_INCOMPATIBLE", "SCOPE_PATH_OUTSIDE_ROOT",
        "SOURCE_NOT_FOUND", "SCOPE_TARGET_NOT_ALLOWED", "SOURCE_FINGERPRINT_MISMATCH"]
    side = "struct<platform:string,instance:string,database:string,schema:string,table:string,field:string>"
    specs = make(f"spec_id int, target {side}, replacement {side}", (1, tuple("pidst") + ("a",), tuple("pidst") + ("b",)), (2, tuple("pidst") + ("a",), tuple("pidst") + ("a",)),
                 (3, tuple("pidst") + ("a",), tuple("pixsy") + ("a",)))
    assert got(r.spec_audit(specs)) == [(1, None, ""), (2, "SPEC_IDENTICAL_FIELDS", ""), (3, "SPEC_UNSUPPORTED_REPLACEMENT", "database,table")]
    raw = make("id int, raw string", (1, '{"k":1,"e":"a"}'), (2, '{"e":"z","k":"x"}'), (3, '{"k":9,"e":"a","u":1}'), (4, "[1]"), (5, '{"e":null}'))
    rules = (r.FieldRule("k", "bigint", low=0, high=5), r.FieldRule("e", allowed=("a", "b"), required=False))
    assert got(r.contract_audit(raw, "raw", rules)) == [(1, 0, None), (2, 2, "TYPE:k"), (3, 2, "RANGE:k"), (4, 1, "NOT_AN_OBJECT"), (5, 1, "MISSING:k")]


SCOPE = "campaign_id int, source_id string, required boolean, identity string, direction string, max_hops int, filters array<string>, principal string, effective_scope string, total int"


def test_reconciliation(make, got):
    def source(filters=("a", "b"), hops=3, total=1):
        return (1, "s", True, "i", "downstream", hops, list(filters), "p", "r", total)

    def code(other):
        return g.scope_equivalence(make("campaign_id int", (1,)), make(SCOPE, source()), make(SCOPE, *other)).first()["refusal_code"]

    assert code([source(total=9)]) is None
    assert {code([source(("b", "a"))]), code([source(hops=4)]), code([])} == {"RECONCILIATION_SCOPE_MISMATCH"}
    drift = make("campaign_id int, consumer_id string, source_id string", (1, "a", "s"), (1, "a", "s"), (1, "b", "s"))
    consumers = make("campaign_id int, consumer_id string, disposition string", (1, "a", "VALIDATED"), (1, "b", "OPAQUE"), (1, "c", "VALIDATED"))
    assert got(g.invalidate_consumers(consumers, drift), "consumer_id", "disposition") == [("a", "STALE"), ("b", "OPAQUE"), ("c", "VALIDATED")]
    sources = make("campaign_id int, source_id string, status string, limitations array<string>", (1, "s", "COMPLETE", ["z"]), (1, "t", "COMPLETE", ["z"]))
    assert [(s["status"], s["limitations"]) for s in g.invalidate_sources(sources, drift, "gone").orderBy("source_id").collect()] == [("STALE", ["gone", "z"]), ("COMPLETE", ["z"])]


def test_gate(make, now, got):
    attempts = make("attempt_id int, campaign_id string, plan_digest string, manifest_digest string, status string, recorded_at int",
                    (1, "c", "p", "m", "REFUSED", 1), (2, "c", "p", "m", "EXECUTED", 2), (3, "c", "p", "n", "INTENT_RECORDED", 3), (4, "c", "q", "m", "OUTCOME_UNKNOWN", 4), (5, "d", "r", "m", "EXECUTED", 5))
    assert got(g.ledger_audit(attempts), "attempt_id", "refusal_code") == [(2, None), (3, "GATE_PLAN_REPLAYED"), (4, "GATE_PLAN_REPLAYED"), (5, None)]
    kind = "campaign_id int, source_id string, required boolean, status string, observed_at string, source_updated_at string, maximum_age_seconds int"
    at = "2024-01-01 12:00:00"
    sources = make(kind, (1, "a", True, "COMPLETE", at, at, 60), (2, "a", True, "PARTIAL", at, at, 60), (3, "a", True, "COMPLETE", at, None, 60),
                   (4, "a", True, "COMPLETE", at, "2024-01-01 11:58:59", 60), (5, "a", False, "PARTIAL", None, None, 60), (6, "a", True, "COMPLETE", "2024-01-01 12:00:31", at, 60))
    for column in ("observed_at", "source_updated_at"):
        sources = sources.withColumn(column, F.col(column).cast("timestamp"))
    assert got(g.gate_freshness(sources, now), "campaign_id", "refusal_code") == [
        (2, "EVIDENCE_REQUIRED_SOURCE_INCOMPLETE"), (3, "RUNTIME_CLOCK_INVALID"), (4, "EVIDENCE_REQUIRED_SOURCE_INCOMPLETE"), (6, "RUNTIME_CLOCK_FUTURE")]
    heads = make("campaign_id int, state string, decision string, manifest_digest string, publication_verified boolean",
                 *[(i, "READY" if i != 2 else "BLOCKED", "READY_TO_RETIRE", "m", i != 8) for i in range(1, 12)])
    plan = [(i, f"p{i}", i != 4, i != 5, i != 7, "m" if i != 9 else "n", "2024-01-01 11:50:00" if i != 6 else "2024-01-01 11:40:00",
             "2024-01-01 12:05:00" if i != 6 else "2024-01-01 11:55:00") for i in range(1, 12) if i != 3]
    plans = make("campaign_id int, plan_digest string, issued boolean, trusted boolean, bound boolean, plan_manifest_digest string, prepared_at string, expires_at string", *plan)
    for column in ("prepared_at", "expires_at"):
        plans = plans.withColumn(column, F.col(column).cast("timestamp"))
    found = "campaign_id int, refusal_code string"
    findings = [("receipts", make(found, (10, "A"), (11, None))), ("scope", make(found, (10, "B"), (11, "B"), (4, "B")))]
    codes = dict(got(g.gate_readiness(heads, plans, findings, now), "campaign_id", "refusal_code"))
    assert [codes[i] for i in range(1, 12)] == [
        None, "GATE_DECISION_NOT_READY", "GATE_PLAN_MISSING", "GATE_PLAN_MISSING", "GATE_PROVENANCE_UNTRUSTED", "GATE_PLAN_EXPIRED", "GATE_PROVENANCE_UNTRUSTED",
        "GATE_PUBLICATION_UNVERIFIED", "GATE_STATE_DRIFT", "A", "B"]
    adapters = make("campaign_id int, adapter string", (1, "git-dbt"), (2, "dbt"), (3, "spark"), (4, None))
    assert got(g.receipt_type_audit(adapters, ["dbt"]), "campaign_id") == [(3,), (4,)]
    long = plans.filter("campaign_id = 1").withColumn("expires_at", F.lit("2024-01-01 12:05:01").cast("timestamp"))
    assert got(g.plan_window(long, now), "refusal_code") == [("GATE_PLAN_INVALID",)]


def test_every_check_has_its_place(make, got):
    """A campaign that fails a later check too is named by the earlier one, whichever kind of check it is."""
    steps = g.GATE_STEPS
    own = {"publication", "manifest"}
    found = [s for s in steps[5:] if s not in own]
    pairs_ = [(steps.index(a), steps.index(b)) for a in steps[5:] for b in steps[5:] if steps.index(a) < steps.index(b)]
    ids = [f"{a}-{b}" for a, b in pairs_]
    fails = {f"{a}-{b}": {steps[a], steps[b]} for a, b in pairs_}
    heads = make("campaign_id string, state string, decision string, manifest_digest string, publication_verified boolean",
                 *[(i, "READY", "READY_TO_RETIRE", "m", "publication" not in fails[i]) for i in ids])
    plans = make("campaign_id string, plan_digest string, issued boolean, trusted boolean, bound boolean, plan_manifest_digest string, prepared_at string, expires_at string",
                 *[(i, i, True, True, True, "n" if "manifest" in fails[i] else "m", "2024-01-01 11:50:00", "2024-01-01 12:05:00") for i in ids])
    for column in ("prepared_at", "expires_at"):
        plans = plans.withColumn(column, F.col(column).cast("timestamp"))
    audits = [(s, make("campaign_id string, refusal_code string", *[(i, "X") for i in ids if s in fails[i]])) for s in reversed(found)]
    first = dict(got(g.gate_readiness(heads, plans, audits, F.to_timestamp(F.lit("2024-01-01 12:00:00"))), "campaign_id", "failed_step"))
    assert first == {i: steps[int(i.split("-")[0])] for i in ids}


def test_sources_as_the_plan_was_bound_to_them(make, got):
    plans = make("campaign_id string, plan_digest string, prepared_at int", ("a", "p", 10), ("b", "q", 10), ("c", "r", None))
    rows = make(
        "campaign_id string, source_id string, role string, observed_at int, snapshot_id int, fingerprint string",
        ("a", "s", "source", 1, 1, "x"), ("a", "s", "source", 9, 2, "y"), ("a", "s", "source", 9, 3, "z"), ("a", "s", "source", 15, 4, "z"),
        ("a", "s", "source", 99, 5, "later"), ("a", "v", "binding", 10, 6, "one"), ("a", "v", "binding", 11, 7, "two"),
        ("b", "s", "source", 12, 8, "new"), ("b", "t", "source", 3, 9, "old"), ("c", "s", "source", 1, 10, "x"), ("d", "s", "source", 1, 11, "x"))
    found = g.bound_snapshots(plans, rows, F.lit(20))
    assert got(found, "campaign_id", "source_id", "bound_fingerprint", "fingerprint", "refusal_code") == [
        ("a", "s", "z", "z", None), ("a", "v", "one", "two", "GATE_STATE_DRIFT"), ("b", "s", None, "new", "GATE_SOURCE_DRIFT"), ("b", "t", "old", "old", None),
        ("c", "s", None, "x", "GATE_SOURCE_DRIFT")]


def test_consumed_plans(make, got):
    heads = make("campaign_id string, manifest_digest string", ("a", "m1"), ("b", "m2"), ("c", "m3"))
    plans = make("campaign_id string, plan_digest string", ("a", "p1"), ("b", "p2"), ("c", "p3"))
    attempts = make("campaign_id string, plan_digest string, manifest_digest string, status string",
                    ("a", "p1", "old", "EXECUTED"), ("b", "other", "m2", "OUTCOME_UNKNOWN"), ("c", "p3", "m3", "REFUSED"), ("b", "x", "m1", "EXECUTED"))
    assert got(g.consumed_plans(heads, plans, attempts), "campaign_id") == [("a",), ("b",)]


def test_a_refresh_takes_the_first_observation_after_it(spark, make, got):
    times = lambda df, *names: df.select(*[F.timestamp_seconds(c).alias(c) if c in names else F.col(c) for c in df.columns])
    asked = times(make("refresh_id string, urn string, requested_at int, deadline int",
                       ("r1", "u", 10, 30), ("r2", "u", 20, 25), ("r3", "u", 41, 99), ("r4", "v", 0, 9), ("r5", "u", 20, 22)), "requested_at", "deadline")
    seen = times(make("urn string, source_updated_at int, observed_at int", ("u", 5, 11), ("u", 20, 24), ("u", 12, 28), ("u", 40, 50), ("u", None, 12), ("u", 20, None)),
                 "source_updated_at", "observed_at")
    found = g.refresh_status(asked, seen).withColumn("observed_at", F.unix_seconds("observed_at"))
    assert got(found, "refresh_id", "observed_at", "refusal_code") == [
        ("r1", 24, None), ("r2", 24, None), ("r3", None, "RECONCILIATION_REFRESH_TIMEOUT"), ("r4", None, "RECONCILIATION_REFRESH_TIMEOUT"),
        ("r5", None, "RECONCILIATION_REFRESH_TIMEOUT")]
    n = 100_000  # of each for one URN: pairs would be ten billion
    many = spark.range(n)
    asked = many.select(F.col("id").alias("refresh_id"), F.lit("u").alias("urn"), F.timestamp_seconds("id").alias("requested_at"),
                        F.timestamp_seconds(F.col("id") + 2).alias("deadline"))
    seen = many.select(F.lit("u").alias("urn"), F.timestamp_seconds("id").alias("source_updated_at"), F.timestamp_seconds(F.col("id") + 1).alias("observed_at"))
    late = g.refresh_status(asked, seen)
    assert late.count() == n and late.filter("refusal_code IS NOT NULL OR unix_seconds(observed_at) <> refresh_id + 1").count() == 0
