"""Named queries (one per operator of SURVEY §2) and their oracle SQL."""

from __future__ import annotations

import importlib

from escrowlens.registry.core import REGISTRY, runner

_MODULES = ["q_dashboards", "q_views", "q_catalog", "q_ledger", "q_commands", "q_chat", "q_streams"]


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"escrowlens.registry.{m}")


def queries():
    _load()
    return {name: runner(q) for name, q in REGISTRY.items()}


def oracle_sql():
    _load()
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
