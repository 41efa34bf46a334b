"""All queries of the document operators and their SQL."""

from __future__ import annotations

from inkwell.plans.queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
