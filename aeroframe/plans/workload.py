"""All registered queries."""

from __future__ import annotations

from aeroframe.plans import queries_joins, queries_mesh, queries_metrics, queries_models, queries_sources  # noqa: F401
from aeroframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
