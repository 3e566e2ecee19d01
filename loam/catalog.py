"""All registered queries outside ``loam.llm``, by name."""

from __future__ import annotations

from importlib import import_module

_PLANS = ("search", "ranking", "recall", "analytics", "graphs", "dedup", "lifecycle", "filters", "profiles", "texts", "streams", "context", "lexical", "multiquery", "names")


def _collect(name: str) -> dict:
    found: dict = {}
    for plan in _PLANS:
        found.update(getattr(import_module(f"loam.plans.{plan}").REGISTRY, name))
    return found


def queries() -> dict:
    return _collect("queries")


def oracle_sql() -> dict:
    return _collect("oracles")
