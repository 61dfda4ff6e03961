"""Registered queries."""

from __future__ import annotations


def load_registry():
    """All registered queries by name."""
    import importlib

    from memspark.plans.registry import REGISTRY

    for module in MODULES:
        importlib.import_module(f"memspark.plans.{module}")
    return REGISTRY


MODULES = ("search_queries", "capture_queries", "graph_queries", "session_queries", "store_queries", "upkeep_queries")
