"""Registered queries: name -> (spark, sf_dir) function, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from . import attribution_queries, card_queries, cohort_queries, evidence_queries, feature_queries, frozen_queries, metric_queries, other_queries, refit_queries, residual_queries, severity_queries  # noqa: E402,F401
