"""All registered queries of the core and the SQL that must give the same rows."""

from __future__ import annotations

from wellforge.plans import data_problems, files, images, statistics, tables, vectors

MODULES = [data_problems, files, tables, statistics, vectors, images]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
