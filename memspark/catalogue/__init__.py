"""Queries over the tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from importlib import import_module

MODULES = ("lexical", "vectors", "temporal", "state", "graph", "knowledge", "records", "evaluation", "retrieval", "extended", "fidelity", "grounding", "ingest", "maintenance", "traversal", "context", "counts", "probes", "patterns")


def collected() -> tuple[dict, dict]:
    queries: dict = {}
    oracles: dict = {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLE
    return queries, oracles
