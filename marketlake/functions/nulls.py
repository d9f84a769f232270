"""Missing values: defaults, null tokens, columns that may be absent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def col_or(df: DataFrame, name: str, default=None, dtype: str | None = None) -> Column:
    """Column ``name`` of ``df``, or a typed literal when the table lacks it (exact name match)."""
    source = F.col(f"`{name}`") if name in df.columns else F.lit(default)
    return (source.cast(dtype) if dtype else source).alias(name)


def first_present(df: DataFrame, names: list[str], default=None, dtype: str = "string") -> Column:
    """The first of ``names`` that exists as a column; presence decides, not nullness."""
    for name in names:
        if name in df.columns:
            return F.col(f"`{name}`").cast(dtype)
    return F.lit(default).cast(dtype)


def or_default(column: Column, default) -> Column:
    return F.coalesce(column, F.lit(default))


def text_or_default(column: Column, default: str) -> Column:
    """Default for null and for the empty string."""
    return F.when(column.isNull() | (column == ""), F.lit(default)).otherwise(column)


def null_token(column: Column, token: str = "NA") -> Column:
    return F.nullif(column, F.lit(token))


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def is_filled(column: Column) -> Column:
    """True for a value that is neither null nor, written as text, empty."""
    return column.isNotNull() & (column.cast("string") != "")


def null_safe_sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns], F.lit(0))


def above(column: Column, threshold) -> Column:
    """``column > threshold`` with null counted as false."""
    return F.coalesce(column > threshold, F.lit(False))
