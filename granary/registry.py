"""Queries of the library by name, with their SQL."""

from __future__ import annotations

from . import queries as main_queries
from . import run_queries, source_queries
from .queries import national_selection as flagship

__all__ = ["flagship", "oracle_sql", "queries"]

_PAIRS = main_queries.PAIRS | source_queries.PAIRS | run_queries.PAIRS


def queries() -> dict:
    return {name: query for name, (query, _) in _PAIRS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _PAIRS.items() if sql}
