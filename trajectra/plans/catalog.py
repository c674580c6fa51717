"""Queries of the reference's own operators, by name, and their SQL."""

from __future__ import annotations

from . import q_batch, q_interfaces, q_metrics, q_rewards, q_sequences, q_sources

MODULES = (q_rewards, q_batch, q_sequences, q_metrics, q_sources, q_interfaces)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
