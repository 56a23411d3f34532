"""Registered queries: every operator over whole tables, with SQL that says the same."""

from __future__ import annotations

from rowloom.plans.catalog.registry import ORACLES, QUERIES
from rowloom.plans.catalog import (  # noqa: F401  (importing registers)
    q_actions,
    q_joins,
    q_rollups,
    q_runs,
    q_scalars,
    q_sinks,
    q_sources,
    q_steps,
    q_streaming,
    q_validation,
)

__all__ = ["ORACLES", "QUERIES"]
