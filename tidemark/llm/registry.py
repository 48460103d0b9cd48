"""Queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from tidemark.llm import q_audit, q_copies, q_media, q_native, q_quality, q_tokens

_MODULES = (q_copies, q_native, q_media, q_quality, q_tokens, q_audit)
QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
