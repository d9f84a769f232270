"""Model-ready features: one-hot columns, guarded ratios, distances and neighborhood trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.numbers import ratio, ratio_or_numerator
from marketlake.functions.text import column_suffix

def category_lists(df: DataFrame, columns: list[str], at_most: int | None = None) -> dict[str, list]:
    """Distinct non-null values of each column, sorted, from one job: the column names of a wide one-hot table.

    Values are made distinct map-side and per pair before anything reaches the driver. With ``at_most``, a column with
    more values raises. For columns whose values grow with the table use ``one_hot_rows``, which needs no list.
    """
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns
    ]))).where(F.col("value").isNotNull()).distinct()
    if at_most is not None:
        pairs = pairs.limit(at_most * len(columns) + 1)  # more than this is an error
    found = pairs.collect()
    lists = {c: sorted(r["value"] for r in found if r["name"] == c) for c in columns}
    if at_most is not None and (len(found) > at_most * len(columns) or any(len(v) > at_most for v in lists.values())):
        raise ValueError(f"more than {at_most} categories in one of {columns}")
    return lists


def one_hot_rows(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """``(id, feature, value)``: the ones of a one-hot table as rows, for any number of categories."""
    marks = F.array(*[F.struct(
        F.concat(F.lit(f"{c}_"), F.col(f"`{c}`").cast("string")).alias("feature"), F.lit(1).alias("value")) for c in columns])
    return df.select(F.col(id_column), F.inline(F.filter(marks, lambda m: m["feature"].isNotNull())))


def one_hot(df: DataFrame, categories: dict[str, list], numeric_names: bool = False) -> list[Column]:
    """1/0 columns named ``<column>_<value>``. Values whose names coincide share no column: the later one
    in sorted order gets a numbered suffix."""
    taken = set(df.columns)
    columns = []
    for source, values in categories.items():
        for value in values:
            base = f"{source}_{column_suffix(value)}"
            name, n = base, 2
            while name in taken:
                name, n = f"{base}_{n}", n + 1
            taken.add(name)
            hit = F.col(f"`{source}`").cast("string") == F.lit(value)
            columns.append(F.when(hit, 1).otherwise(0).alias(name))
    return columns


def as_flag(column: Column) -> Column:
    return F.coalesce(column, F.lit(False)).cast("int")


def neighborhood_trends(trends: DataFrame) -> DataFrame:
    return trends.where(F.col("period_type") == "neighborhood_monthly").select(
        F.col("neighborhood").alias("__place"), F.col("sale_year").alias("__year"), F.col("sale_month").alias("__month"),
        F.col("avg_price").alias("neighborhood_avg_price"), F.col("median_price").alias("neighborhood_median_price"))


def with_neighborhood_trend(features: DataFrame, trends: DataFrame) -> DataFrame:
    """Left join of the neighborhood's price level in the month of sale, and the price relative to it.

    The join strategy is left to the optimizer: the trend side is small, yet it grows with the number of
    places, and a hot neighborhood is split by the adaptive skew join.
    """
    right = neighborhood_trends(trends)
    joined = features.join(
        right,
        (features["neighborhood"] == right["__place"]) & (features["transaction_year"] == right["__year"])
        & (features["transaction_month"] == right["__month"]),
        "left").drop("__place", "__year", "__month")
    level = F.col("neighborhood_avg_price")
    return joined.withColumn(
        "price_to_neighborhood_ratio",
        F.when(level > 0, ratio(F.col("target_price"), level)).otherwise(F.lit(1.0)))


def time_parts(date: Column) -> list[Column]:
    return [F.year(date).alias("transaction_year"), F.month(date).alias("transaction_month"),
            F.quarter(date).alias("transaction_quarter")]


def room_ratios(rooms: Column, bedrooms: Column, bathrooms: Column) -> list[Column]:
    return [ratio_or_numerator(rooms, bedrooms).alias("rooms_per_bedroom"),
            ratio_or_numerator(rooms, bathrooms).alias("rooms_per_bathroom")]
