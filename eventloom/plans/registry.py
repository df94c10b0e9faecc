"""All registered queries: name → (Spark query, SQL for checking or None)."""

from __future__ import annotations

from . import cohort_queries, model_queries, sequences, source_queries, token_queries, visit_queries

MODULES = [sequences, visit_queries, token_queries, cohort_queries, model_queries, source_queries]


def registered():
    out = {}
    for module in MODULES:
        for name, pair in module.QUERIES.items():
            assert name not in out, name
            out[name] = pair
    return out
