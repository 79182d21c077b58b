"""All queries of the core and their SQL."""

from __future__ import annotations

from threadloom.plans import adapters, corpus, evaluation, measures, models, problems, texts

MODULES = [problems, corpus, evaluation, texts, models, adapters, measures]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
