"""Results for dashboards: filtered reads of the mart tables.

Filters are column predicates, so they reach the file scan of a stored mart. Sorting happens only here.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.dates import first_of_month, month_name, year_quarter_label
from marketlake.functions.jsontext import json_number, number_map
from marketlake.functions.numbers import ratio

PREDICTION_LIMIT = 20  # fixed value: rows of the prediction list


@dataclass(frozen=True)
class Filters:
    """Optional restrictions. Each applies wherever the table has the column, and only if given."""

    region: str | None = None
    neighborhood: str | None = None
    start: date | None = None
    end: date | None = None
    property_types: tuple[str, ...] = ()
    feature_ids: tuple[int, ...] = ()


def apply_filters(df: DataFrame, filters: Filters | None) -> DataFrame:
    if filters is None:
        return df
    have = set(df.columns)
    for column, value in (("region_name", filters.region), ("neighborhood_name", filters.neighborhood)):
        if value is not None and column in have:
            df = df.where(F.col(column) == value)
    for column, values in (("property_type", filters.property_types), ("feature_id", filters.feature_ids)):
        if values and column in have:
            df = df.where(F.col(column).isin(*values))
    if filters.start and filters.end:
        if {"period_year", "period_month"} <= have:
            # Comparing year and month keeps the predicate on stored columns.
            month = F.col("period_year") * 12 + F.col("period_month")
            first = filters.start.year * 12 + filters.start.month + (1 if filters.start.day > 1 else 0)
            df = df.where(F.col("period_year").between(filters.start.year, filters.end.year)
                          & month.between(first, filters.end.year * 12 + filters.end.month))
        elif "period_year" in have:
            df = df.where(F.col("period_year").between(filters.start.year, filters.end.year))
        elif "date" in have:
            df = df.where(F.col("date").between(filters.start, filters.end))
    return df


def region_names(trends: DataFrame) -> DataFrame:
    """(region_id, region_name) once each: joining this, not the trend rows, leaves no fan-out to undo."""
    return trends.select("region_id", "region_name").distinct()


def regions(trends: DataFrame) -> DataFrame:
    return trends.select("region_name").distinct().orderBy("region_name")


def neighborhoods(comparison: DataFrame, trends: DataFrame, region: str | None = None) -> DataFrame:
    if region:
        wanted = trends.where(F.col("region_name") == region).select("region_id")
        comparison = comparison.join(wanted, "region_id", "left_semi")
    return comparison.select("neighborhood_name").distinct().orderBy("neighborhood_name")


def date_range(trends: DataFrame, default_days: int = 365) -> DataFrame:
    """First and last month; without data the last year up to today."""
    month = first_of_month(F.col("period_year"), F.col("period_month"))
    return trends.agg(F.min(month).alias("a"), F.max(month).alias("b")).select(
        F.coalesce("a", F.date_sub(F.current_date(), default_days)).alias("min_date"),
        F.coalesce("b", F.current_date()).alias("max_date"))


def price_by_region(trends: DataFrame, filters: Filters | None = None, weighted: bool = False) -> DataFrame:
    """Averages of the monthly values per region; ``weighted`` weighs them by the number of sales."""
    def mean(name: str) -> Column:
        value = F.col(name).cast("double")
        if weighted:
            return ratio(F.sum(value * F.col("transaction_count")), F.sum("transaction_count"))
        return F.avg(value)

    return apply_filters(trends, filters).groupBy("region_name", "region_id").agg(
        mean("avg_price").alias("avg_price"), mean("median_price").alias("median_price"),
        F.max("max_price").alias("max_price"), F.min("min_price").alias("min_price"),
        F.sum("transaction_count").alias("total_transactions")).orderBy("region_name")


def price_series(trends: DataFrame, filters: Filters | None = None) -> DataFrame:
    return apply_filters(trends, filters).select(
        "region_name", "period_year", "period_month",
        first_of_month(F.col("period_year"), F.col("period_month")).alias("date"),
        "avg_price", "median_price", "transaction_count").orderBy("period_year", "period_month", "region_name")


def feature_list(features: DataFrame, category: str | None = None) -> DataFrame:
    rows = features if category is None else features.where(F.col("feature_category") == category)
    return rows.select("feature_id", "feature_name", "feature_category", "global_importance_score",
                       "correlation_with_price").orderBy(F.desc("global_importance_score"), "feature_id")


def top(df: DataFrame, k: int, score: Column, tie: str) -> DataFrame:
    """The k best rows; ties broken by a key, so the choice repeats."""
    return df.orderBy(score.desc(), F.col(tie)).limit(k)


def regional_variation(variation: DataFrame, features: DataFrame, trends: DataFrame, filters: Filters | None = None) -> DataFrame:
    named = apply_filters(variation, filters).join(features.select("feature_id", "feature_name"), "feature_id")
    placed = named.join(apply_filters(region_names(trends), filters), "region_id")
    return placed.select("feature_name", "region_name", "importance_score", "relative_importance").orderBy(
        "feature_name", "region_name")


def temporal_variation(variation: DataFrame, features: DataFrame, filters: Filters | None = None) -> DataFrame:
    named = apply_filters(variation, filters).join(features.select("feature_id", "feature_name"), "feature_id")
    return named.select(
        "feature_name", "period_year", "period_quarter",
        year_quarter_label(F.col("period_year"), F.col("period_quarter")).alias("period"), "importance_score",
    ).orderBy("feature_name", "period_year", "period_quarter")


def neighborhood_comparison(comparison: DataFrame, trends: DataFrame, filters: Filters | None = None) -> DataFrame:
    names = apply_filters(region_names(trends), filters)
    return apply_filters(comparison, filters).join(names, "region_id").select(
        "neighborhood_id", "neighborhood_name", "city_name", "region_name", "avg_price", "price_per_sqft",
        "price_change_yoy", "avg_days_on_market", "walkability_score", "school_rating", "crime_index",
    ).orderBy(F.desc("avg_price"), "neighborhood_name")


def seasonal_patterns(patterns: DataFrame, trends: DataFrame, filters: Filters | None = None) -> DataFrame:
    names = apply_filters(region_names(trends), filters)
    return patterns.join(names, "region_id").select(
        "region_name", "month", month_name(F.col("month")).alias("month_name"), "price_index",
        "transaction_volume_index", "days_on_market_index", "year_of_analysis").orderBy("region_name", "month")


def value_index(comparison: DataFrame) -> DataFrame:
    """Mean of walkability, schools and safety per unit of price."""
    quality = (F.col("walkability_score").cast("double") + F.col("school_rating").cast("double")
               + (F.lit(10.0) - F.col("crime_index").cast("double"))) / F.lit(3.0)
    return comparison.select("neighborhood_name", quality.alias("quality_score"), "price_per_sqft").withColumn(
        "value_index", ratio(F.col("quality_score"), F.col("price_per_sqft")) * F.lit(10000.0)
    ).orderBy(F.desc_nulls_last("value_index"), "neighborhood_name")


def scaled_to_ten(df: DataFrame, columns: Iterable[str], inverted: Iterable[str] = ()) -> DataFrame:
    """``<column>_norm``: value over the table's maximum, times ten; inverted columns count down from ten."""
    columns = list(columns)
    highest = df.agg(F.struct(*[F.max(F.col(c).cast("double")).alias(c) for c in columns]).alias("m")).scalar()
    scaled = {c: ratio(F.col(c), highest[c]) * F.lit(10.0) for c in columns}
    return df.select("*", *[
        (F.lit(10.0) - s if c in set(inverted) else s).alias(f"{c}_norm") for c, s in scaled.items()])


def min_max_ratio(df: DataFrame, column: str, name: str = "price_ratio") -> DataFrame:
    """Position between the table's minimum and maximum, one half when all values are equal."""
    value = F.col(column).cast("double")
    ends = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("e")).scalar()
    return df.withColumn(name, F.when(
        ends["high"] > ends["low"], ratio(value - ends["low"], ends["high"] - ends["low"])).otherwise(F.lit(0.5)))


def feature_matrix(variation: DataFrame, region_list: list[str], normalise: bool = True) -> DataFrame:
    """Feature rows, one column per region; with ``normalise`` each row is divided by its own mean."""
    cells = variation.groupBy("feature_name").pivot("region_name", region_list).agg(F.first("relative_importance"))
    if not normalise:
        return cells
    filled = [F.col(f"`{c}`") for c in region_list]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in filled), F.lit(0.0))
    present = sum((c.isNotNull().cast("int") for c in filled), F.lit(0))
    mean = ratio(total, present)
    return cells.select("feature_name", *[ratio(F.col(f"`{c}`"), mean).alias(c) for c in region_list])


def price_measures_long(by_region: DataFrame) -> DataFrame:
    """Average and median price per region as (region_name, measure, price)."""
    return by_region.unpivot("region_name", ["avg_price", "median_price"], "measure", "price")


def active_model(models: DataFrame) -> DataFrame:
    return models.where("is_active").orderBy("model_name", "model_id").limit(1)


def model_list(models: DataFrame) -> DataFrame:
    """Active models first, with the metrics taken out of their JSON text."""
    metrics = ("rmse", "mae", "r2", "explained_variance")
    return models.select(
        "model_id", "model_name", "model_version", "training_date", "model_metrics", "is_active",
        *[json_number(F.col("model_metrics"), m, 0.0).alias(m) for m in metrics]).orderBy(F.desc("is_active"), "model_name")


def predictions(results: DataFrame, models: DataFrame, limit: int = PREDICTION_LIMIT) -> DataFrame:
    active = models.where("is_active").select("model_id", "model_name", "model_metrics")
    return results.join(active, "model_id").select(
        "prediction_id", "property_id", "predicted_price", "prediction_interval_low", "prediction_interval_high",
        "confidence_score", "feature_contributions", "model_name", "model_metrics").orderBy("prediction_id").limit(limit)


def prediction_intervals(results: DataFrame, k: int = 10) -> DataFrame:
    """The k highest predictions with confidence in percent and the interval width."""
    best = top(results, k, F.col("predicted_price"), "prediction_id")
    return best.select(
        "prediction_id", "property_id", "predicted_price", "prediction_interval_low", "prediction_interval_high",
        (F.col("confidence_score").cast("double") * 100).alias("confidence_pct"),
        (F.col("prediction_interval_high") - F.col("prediction_interval_low")).alias("interval_width"))


def contributions(results: DataFrame) -> DataFrame:
    """One row per prediction and feature, largest contribution first."""
    return results.select(
        "prediction_id", F.explode(number_map(F.col("feature_contributions"))).alias("feature", "contribution")
    ).orderBy("prediction_id", F.desc("contribution"), "feature")
