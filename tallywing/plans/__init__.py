"""Named queries over the operators, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

import importlib

MODULES = [
    "corpus", "benchmark", "dashboard", "columns", "rules", "logs", "models", "forecasts", "tables", "search", "streams",
]


def load_registry():
    """Import every module of named queries and return the registry."""
    for m in MODULES:
        importlib.import_module(f"tallywing.plans.{m}")
    from tallywing.plans.registry import REGISTRY

    return REGISTRY
