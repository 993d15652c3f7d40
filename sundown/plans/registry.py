"""All queries and their SQL twins by name."""

from __future__ import annotations

from sundown.plans import (
    events_plans,
    gate_plans,
    lineage_plans,
    policy_plans,
    quality_plans,
    report_plans,
    scan_plans,
    streaming_plans,
)

FLAGSHIP = "i1_campaign_rollup"
_MODULES = (
    quality_plans, lineage_plans, scan_plans, events_plans, streaming_plans, policy_plans, gate_plans, report_plans,
)

QUERIES = {name: build for module in _MODULES for name, build in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
