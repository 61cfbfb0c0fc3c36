"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from strataloom.plans import suites


def queries() -> dict:
    return {name: query for suite in suites() for name, query in suite.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for suite in suites() for name, sql in suite.SQL.items()}
