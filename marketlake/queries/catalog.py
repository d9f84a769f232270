"""All families in one place."""

from __future__ import annotations

from marketlake.queries import (
    clean, files, housing, learning, learning_rows, market, marts, quality, scalars, serving, streams, tables, trends)
from marketlake.queries.base import Query

FAMILIES = tuple(module.family for module in (
    clean, quality, housing, tables, files, trends, market, learning_rows, marts, serving, scalars, learning, streams))


def all_queries() -> dict[str, Query]:
    return {name: query for family in FAMILIES for name, query in family.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.sql.items()}
