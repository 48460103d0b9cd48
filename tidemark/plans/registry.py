"""Registered queries over the driver's tables and their DuckDB counterparts."""

from __future__ import annotations

from tidemark.plans import feeds, texts  # noqa: F401  register their queries
from tidemark.plans.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
