import pytest
from pyspark.sql import functions as F

from sundown.operators import policy as p
from sundown.operators import truth
from sundown.vocabulary import DISPOSITIONS, OPEN_DISPOSITIONS

OK = ("a", "VALIDATED")
# name, changed facts, consumers, ids missing from the inventory, decision, codes
SCENARIOS = [
    ("clean-isolated-ready", {}, [OK], [], "READY_TO_RETIRE", ""),
    ("rich-graph-unsafe", {}, [OK, ("b", "OPAQUE")], [], "UNSAFE", "POLICY_CONSUMER_OPAQUE"),
    ("late-consumer-unsafe", {}, [OK, ("b", "DISCOVERED")], ["b"], "UNSAFE",
     "POLICY_CONSUMER_DISCOVERED,RECONCILIATION_NEW_CONSUMER"),
    ("incomplete-pagination-blocked", {"evidence_status": "PARTIAL", "pagination_complete": False}, [OK], [], "BLOCKED",
     "EVIDENCE_PAGINATION_FAILED,EVIDENCE_REQUIRED_SOURCE_INCOMPLETE"),
    ("stale-native-data-blocked", {"native_data_fresh": False}, [OK], [], "BLOCKED", "EVIDENCE_REQUIRED_SOURCE_INCOMPLETE"),
    ("table-only-lineage-unsafe", {}, [OK, ("b", "OPAQUE")], [], "UNSAFE", "POLICY_CONSUMER_OPAQUE"),
    ("ambiguous-identity-blocked", {"identity_match_count": 2}, [OK], [], "BLOCKED", "IDENTITY_AMBIGUOUS"),
    ("incompatible-type-unsafe", {"replacement_compatible": False}, [OK], [], "UNSAFE", "SPEC_REPLACEMENT_INCOMPATIBLE"),
    ("unmapped-value-unsafe", {"quality_failures": 1}, [("a", "FAILED")], [], "UNSAFE",
     "POLICY_CONSUMER_FAILED,VALIDATION_RECEIPT_FAILED"),
    ("null-inflation-unsafe", {"quality_failures": 1}, [("a", "FAILED")], [], "UNSAFE",
     "POLICY_CONSUMER_FAILED,VALIDATION_RECEIPT_FAILED"),
    ("semantic-drift-unsafe", {"quality_failures": 1}, [("a", "FAILED")], [], "UNSAFE",
     "POLICY_CONSUMER_FAILED,VALIDATION_RECEIPT_FAILED"),
    ("healthcare-selective-impact-unsafe", {"quality_failures": 2}, [("a", "FAILED"), ("b", "FAILED"), ("c", "VALIDATED")], [],
     "UNSAFE", "POLICY_CONSUMER_FAILED,VALIDATION_RECEIPT_FAILED"),
    ("ownership-context-no-closure", {}, [OK, ("b", "OPAQUE")], [], "UNSAFE", "POLICY_CONSUMER_OPAQUE"),
    ("disappearing-edge-no-closure", {}, [OK, ("b", "STALE")], [], "UNSAFE", "POLICY_CONSUMER_STALE"),
]
CLEAN = {"identity_match_count": 1, "replacement_compatible": True, "evidence_status": "COMPLETE", "pagination_complete": True,
         "native_data_fresh": True, "quality_failures": 0, "reconciled": True}


def test_fourteen_scenarios(make, got):
    facts = make(
        "scenario_id string, identity_match_count int, replacement_compatible boolean, evidence_status string, "
        "pagination_complete boolean, native_data_fresh boolean, quality_failures int, reconciled boolean",
        *[(name, *{**CLEAN, **changed}.values()) for name, changed, *_ in SCENARIOS])
    consumers = make("scenario_id string, consumer_id string, disposition string",
                     *[(n, i, d) for n, _, cs, *_ in SCENARIOS for i, d in cs])
    inventory = make("scenario_id string, consumer_id string",
                     *[(n, i) for n, _, cs, late, *_ in SCENARIOS for i, _ in cs if i not in late])
    decided = truth.expected_decisions(facts, consumers, inventory, consumers)
    assert got(decided, "scenario_id", "decision", "codes") == sorted((n, d, c) for n, *_, d, c in SCENARIOS)
    same = truth.compare_decisions(decided, decided)
    assert truth.comparison_summary(same).first().asDict() == {
        "matched_scenarios": 14, "diverged_scenarios": 0, "false_readiness": 0, "corrupt_truth_rejected": True}
    wrong = decided.withColumn("decision", F.lit("READY_TO_RETIRE"))
    assert truth.comparison_summary(truth.compare_decisions(wrong, decided)).first()["false_readiness"] == 13


@pytest.fixture
def judge(make):
    def run(consumers=(("x", "VALIDATED"),), sources=((True, "COMPLETE"),), mode="live", reconciled=True, inputs=True,
            late=(), reviews=(), policy=p.Policy()):
        campaigns = make("campaign_id string, mode string, reconciled boolean, inputs_match boolean", ("c", mode, reconciled, inputs))
        sources_df = make("campaign_id string, source_id string, required boolean, status string",
                          *[("c", f"s{i}", r, st) for i, (r, st) in enumerate(sources)])
        consumers_df = make("campaign_id string, consumer_id string, disposition string", *[("c", i, d) for i, d in consumers])
        ids = "campaign_id string, consumer_id string"
        inventory = make(ids, *[("c", i) for i, _ in consumers if i not in late])
        current = make(ids, *[("c", i) for i, _ in consumers])
        reviews_df = make("campaign_id string, code string, consumer_id string", *[("c", r, None) for r in reviews])
        decisions, blockers = p.evaluate(campaigns, sources_df, consumers_df, inventory, current, reviews_df, policy)
        row = decisions.first()
        codes = sorted(r["code"] for r in blockers.filter(f"severity > {p.REVIEW}").collect())
        assert row["blockers"] == len(codes)
        return row["decision"], codes

    return run


@pytest.mark.parametrize("disposition", DISPOSITIONS)
def test_each_disposition(judge, disposition):
    decision, codes = judge(consumers=(("x", disposition),))
    if disposition in OPEN_DISPOSITIONS:
        assert (decision, codes) == ("UNSAFE", [f"POLICY_CONSUMER_{disposition}"])
    elif disposition == "WAIVED":
        assert (decision, codes) == ("BLOCKED", ["POLICY_WAIVER_FORBIDDEN"])
    elif disposition == "UNRESOLVED":
        assert (decision, codes) == ("BLOCKED", ["IDENTITY_NOT_FOUND"])
    else:
        assert (decision, codes) == ("READY_TO_RETIRE", [])


def test_waiver_settings(judge):
    waived = (("x", "WAIVED"),)
    assert judge(waived, policy=p.Policy(allow_waivers=True))[0] == "REVIEW_REQUIRED"
    assert judge(waived, policy=p.Policy(allow_waivers=True, waivers_satisfy_closure=True))[0] == "READY_TO_RETIRE"


@pytest.mark.parametrize("change, codes", [
    ({"consumers": ()}, ["EVIDENCE_EMPTY_RESULT_UNPROVEN"]),
    ({"sources": ()}, ["EVIDENCE_REQUIRED_SOURCE_INCOMPLETE"]),
    ({"sources": ((False, "COMPLETE"),)}, ["EVIDENCE_REQUIRED_SOURCE_INCOMPLETE"]),
    ({"sources": ((True, "PARTIAL"), (True, None), (False, "STALE"))}, ["EVIDENCE_REQUIRED_SOURCE_INCOMPLETE"] * 2),
    ({"mode": None, "sources": ()}, ["EVIDENCE_REQUIRED_SOURCE_INCOMPLETE"]),
    ({"mode": "fixture"}, ["EVIDENCE_MODE_NOT_LIVE"]),
    ({"reconciled": False}, ["RECONCILIATION_REQUIRED"]),
    ({"inputs": False}, ["POLICY_INPUT_DRIFT"]),
    ({"consumers": (("x", "NEW_KIND"),)}, ["CONTRACT_UNKNOWN_DISPOSITION"]),
])
def test_blockers(judge, change, codes):
    assert judge(**change) == ("BLOCKED", codes)


def test_unsafe_lists_blockers_too(judge):
    assert judge((("x", "VALIDATED"),), late=("x",), reconciled=False) == (
        "UNSAFE", ["RECONCILIATION_NEW_CONSUMER", "RECONCILIATION_REQUIRED"])
    assert judge(reviews=("R",))[0] == "REVIEW_REQUIRED"


def test_drift_and_membership(make, got):
    key = "campaign_id string, input_key string, digest string"
    drift = p.input_drift(make(key, ("c", "a", "1"), ("c", "b", "1"), ("c", "d", "1")), make(key, ("c", "a", "1"), ("c", "b", "2"), ("c", "e", "1")))
    assert got(drift, "input_key") == [("b",), ("d",), ("e",)]
    ids = "campaign_id string, consumer_id string"
    diff = p.membership_diff(make(ids, ("c", "x"), ("c", "y")), make(ids, ("c", "y"), ("c", "z"), ("c", "z")))
    assert got(diff, "consumer_id", "change") == [("x", "disappeared"), ("y", "unchanged"), ("z", "added")]


def test_each_campaign_by_its_own_policy(make, got):
    """Four policies at once give what each gives alone."""
    ways = {"none": None, "waivers": (None, None, True, None), "closing": (None, None, True, True), "loose": (False, False, None, None)}
    flags = "struct<requires_live_evidence:boolean,require_reconciliation:boolean,allow_waivers:boolean,waivers_satisfy_closure:boolean>"
    ids = [f"{w}-{case}" for w in ways for case in ("waived", "replayed")]
    campaigns = make(f"campaign_id string, mode string, reconciled boolean, inputs_match boolean, policy {flags}", *[
        (i, "live" if i.endswith("waived") else "replay", i.endswith("waived"), True, ways[i.split("-")[0]]) for i in ids])
    sources = make("campaign_id string, source_id string, required boolean, status string", *[(i, "s", True, "COMPLETE") for i in ids])
    consumers = make("campaign_id string, consumer_id string, disposition string", *[(i, "k", "WAIVED" if i.endswith("waived") else "VALIDATED") for i in ids])
    members = consumers.select("campaign_id", "consumer_id")
    mixed = p.evaluate(campaigns, sources, consumers, members, members, policy=p.CampaignPolicy())
    assert dict(got(mixed[0], "campaign_id", "decision")) == {
        "none-waived": "BLOCKED", "waivers-waived": "REVIEW_REQUIRED", "closing-waived": "READY_TO_RETIRE", "loose-waived": "BLOCKED",
        "none-replayed": "BLOCKED", "waivers-replayed": "BLOCKED", "closing-replayed": "BLOCKED", "loose-replayed": "READY_TO_RETIRE"}
    for way, given in ways.items():
        alone = p.Policy(**{n: v for n, v in zip(("requires_live_evidence", "require_reconciliation", "allow_waivers", "waivers_satisfy_closure"), given or ()) if v is not None})
        mine = f"campaign_id LIKE '{way}-%'"
        single = p.evaluate(campaigns.drop("policy").filter(mine), sources, consumers.filter(mine), members.filter(mine), members.filter(mine), policy=alone)
        for a, b in zip(mixed, single):
            assert got(a.filter(mine), *b.columns) == got(b, *b.columns)
