"""All core queries and the SQL they are held against."""

from __future__ import annotations

from spanwork.plans import checks, drift, graphs, results, selecting, sequences, texts

MODULES = (results, selecting, texts, graphs, sequences, checks, drift)
FLAGSHIP = "completion_by_dim"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
