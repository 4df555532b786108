"""Every query of the engine by name, and its SQL for the independent check."""

from __future__ import annotations

from factloom.plans import blocks, facts, files, ledger, matching, measures, names, serving, sheets, texts, usage  # noqa: F401  they register their queries
from factloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
