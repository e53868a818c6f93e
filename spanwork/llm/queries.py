"""All queries of this package and the SQL they are held against."""

from __future__ import annotations

from spanwork.llm import (
    leaks_queries,
    mixture_queries,
    near_edits_queries,
    overlap_queries,
    packing_queries,
    related_splits_queries,
    toxicity_queries,
)

MODULES = (mixture_queries, overlap_queries, related_splits_queries, near_edits_queries, packing_queries, leaks_queries, toxicity_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
