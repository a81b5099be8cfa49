"""All registered queries of this folder and the SQL that must give the same rows."""

from __future__ import annotations

from wellforge.llm import queries_leaks, queries_percentiles, queries_texts, queries_vectors

MODULES = [queries_vectors, queries_percentiles, queries_leaks, queries_texts]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
