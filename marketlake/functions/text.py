"""Text clean-up and labels chosen from text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash_spaces(column: Column) -> Column:
    """Runs of white space become one space; both ends trimmed."""
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def drop_spaces(column: Column) -> Column:
    return F.regexp_replace(column, r"\s+", "")


def value_map(column: Column, mapping: dict, default=None) -> Column:
    """Look a value up in a short fixed mapping."""
    result = None
    for key, label in mapping.items():
        hit = column == F.lit(key)
        result = F.when(hit, F.lit(label)) if result is None else result.when(hit, F.lit(label))
    return F.lit(default) if result is None else result.otherwise(F.lit(default))


def like_ladder(column: Column, rungs: Iterable[tuple[str, object]], default=None) -> Column:
    """Result of the first LIKE pattern that matches."""
    result = None
    for pattern, label in rungs:
        hit = column.like(pattern)
        result = F.when(hit, F.lit(label)) if result is None else result.when(hit, F.lit(label))
    return F.lit(default) if result is None else result.otherwise(F.lit(default))


def membership_label(column: Column, groups: dict[str, tuple], default: str) -> Column:
    """Label of the first group that contains the value."""
    result = None
    for label, members in groups.items():
        hit = column.isin(*members)
        result = F.when(hit, F.lit(label)) if result is None else result.when(hit, F.lit(label))
    return F.lit(default) if result is None else result.otherwise(F.lit(default))


def column_suffix(value) -> str:
    """Part of a column name made from a data value."""
    return str(value).replace(" ", "_").replace("-", "_").lower()
