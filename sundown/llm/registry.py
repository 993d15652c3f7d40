"""The queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from sundown.llm import dedup_plans, label_plans, matrix_plans, mix_plans, phrase_plans, search_plans, substring_plans, token_plans

_MODULES = (dedup_plans, label_plans, matrix_plans, mix_plans, phrase_plans, search_plans, substring_plans, token_plans)

QUERIES = {name: build for module in _MODULES for name, build in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
