"""Every query of the engine by name, with the SQL that DuckDB checks it against."""

from __future__ import annotations

import importlib

MODULES: list[str] = ["graph_queries", "scoring_queries", "gate_queries", "map_queries", "text_queries", "ontology_queries"]


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"signflow.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"signflow.plans.{name}").ORACLES
    return out
