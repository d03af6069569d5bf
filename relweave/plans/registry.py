"""All registered queries by name, and their SQL where it can say the same."""

from __future__ import annotations

import importlib

MODULES = ("q_sources", "q_relations", "q_retrieval", "q_graph", "q_tagging")

QUERIES: dict = {}
ORACLE: dict = {}

for _name in MODULES:
    _module = importlib.import_module(f"relweave.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
