"""Registered queries against their SQL twins on the smallest tables."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from sundown.plans import registry

FOLDER = "/root/testdata/sf0.001"
NAMES = list(registry.QUERIES)
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the warehouse tables are not here")


@pytest.fixture(scope="module")
def warehouse():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_equals_twin(spark, warehouse, name):
    good, note, _ = compare(spark, warehouse, name, FOLDER)
    assert good, note
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if bad in plan]


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLES)


# The most that a plan may read: each rule evaluates its input once, into a table.
RELATIONS = {
    "e3_campaign_transitions": 2, "e4_consumer_transitions": 6, "e5_snapshot_delta": 2, "e6_consumer_state": 4, "e6_new_consumer_state": 4,
    "e13_state_at_publication": 2, "e15_policy_event_audit": 6, "c18_graph_recall": 6, "c18_graph_differences": 6, "h4_refresh_status": 2,
    "i4_operational_metrics": 4,
}


@pytest.mark.parametrize("name", RELATIONS)
def test_inputs_are_read_once(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[", plan)) <= RELATIONS[name]


def test_every_step_of_the_gate_occurs_and_it_opens(spark):
    from sundown.operators.gate import GATE_STEPS

    found = {r["failed_step"] for r in entry.queries()["h5_gate_live_state"](spark, FOLDER.replace("sf0.001", "sf0.01")).collect()}
    assert found == {None, *GATE_STEPS}
