"""Queries over the driver tables, each with the SQL that says the same to DuckDB."""

from __future__ import annotations

from . import dialogs, labels, records, runs  # noqa: F401
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
