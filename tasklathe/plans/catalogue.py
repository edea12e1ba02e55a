"""All core queries and their SQL."""

from __future__ import annotations

from tasklathe.plans import landed_queries, log_queries, operation_queries


def queries() -> dict:
    return log_queries.QUERIES | landed_queries.QUERIES  # operation_queries registers its own with those of the log


def oracle_sql() -> dict[str, str]:
    return log_queries.SQL | landed_queries.SQL
