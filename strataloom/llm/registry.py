"""The queries op1 to op13 and their SQL."""

from __future__ import annotations

from strataloom.llm import queries as q


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict:
    return dict(q.SQL)
