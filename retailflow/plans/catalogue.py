"""All registered queries."""

from __future__ import annotations

from retailflow.plans import analytic_queries, row_queries, storage_queries, stream_queries, table_queries  # noqa: F401  (registration)
from retailflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
