"""All queries of the core library and their oracles, by name."""

from __future__ import annotations

from marginalia.plans import data_queries, oracle_vault, vault_queries


def queries() -> dict:
    return vault_queries.QUERIES | data_queries.QUERIES


def oracles() -> dict:
    return oracle_vault.ORACLES | data_queries.ORACLES
