"""Mart tables from the analytic tables, conformed to their contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions.numbers import index_to_mean, ratio, steady_mean, steady_round
from marketlake.operators import importance, market
from marketlake.operators.history import dictionary
from marketlake.sources import contracts

MODEL_VERSION = "v1.0"  # fixed value
DAYS_DEFAULT = 30


def region_key(separator: str = "/") -> Column:
    """Name of a trend region: region and city together, so a mart row is one (region, city) series."""
    return F.concat_ws(separator, "region", "city")


def region_dictionary(locations: DataFrame) -> DataFrame:
    """(region_name, region_id) from the place columns."""
    return dictionary(locations.select(region_key().alias("region_name")), "region_name", "region_id")


def regional_trends(trends: DataFrame, regions: DataFrame) -> DataFrame:
    """Monthly rows per region with the change against the month before."""
    months = trends.where((F.col("period_type") == "monthly") & F.col("region").isNotNull())
    rows = market.with_momentum(months, ["region", "city"]).select(
        region_key().alias("region_name"), F.col("sale_year").alias("period_year"), F.col("sale_month").alias("period_month"),
        "avg_price", "median_price", "min_price", "max_price", "price_momentum",
        F.col("properties_sold").alias("transaction_count"))
    return contracts.conform(rows.join(regions, "region_name"), contracts.REGIONAL_TRENDS)


def neighborhood_comparison(
    trends: DataFrame,
    indicators: DataFrame,
    places: DataFrame,
    regions: DataFrame,
    scores: DataFrame | None = None,
) -> DataFrame:
    """One row per neighborhood: mean prices, price change of the latest month over the same month a year
    before (0 where no month has one), mean days on market, and the optional scores (walkability, school, crime).

    ``places`` is any table with neighborhood, city and region; each neighborhood takes its first city.
    """
    months = trends.where((F.col("period_type") == "neighborhood_monthly") & F.col("neighborhood").isNotNull())
    changed = market.with_year_over_year(months, ["neighborhood"])
    unit = steady_mean("avg_unit_price") if "avg_unit_price" in trends.columns else F.lit(None).cast("double")
    when = F.col("sale_year") * 100 + F.col("sale_month")
    prices = changed.groupBy("neighborhood").agg(
        steady_mean("avg_price").alias("avg_price"), unit.alias("price_per_sqft"),
        F.max_by("yoy_pct", F.when(F.col("yoy_pct").isNotNull(), when)).alias("price_change_yoy"))
    days = indicators.where(F.col("location_type") == "neighborhood").groupBy("neighborhood").agg(
        steady_mean("avg_days_on_market").alias("avg_days_on_market"))
    located = places.where(F.col("neighborhood").isNotNull()).groupBy("neighborhood").agg(
        F.min(F.struct("city", region_key().alias("region_name"))).alias("place"))
    rows = (
        prices.join(days, "neighborhood", "left").join(located, "neighborhood")
        .withColumn("region_name", F.col("place.region_name")).join(regions, "region_name")
        .join(dictionary(prices, "neighborhood", "neighborhood_id"), "neighborhood"))
    if scores is not None:
        rows = rows.join(scores, "neighborhood", "left")
    return contracts.conform(rows.select(
        "neighborhood_id", F.col("neighborhood").alias("neighborhood_name"), F.col("place.city").alias("city_name"),
        "region_id", "avg_price", "price_per_sqft",
        F.coalesce("price_change_yoy", F.lit(0.0)).alias("price_change_yoy"),
        F.coalesce(steady_round(F.col("avg_days_on_market"), 0), F.lit(DAYS_DEFAULT)).alias("avg_days_on_market"),
        *[F.col(c) for c in ("walkability_score", "school_rating", "crime_index") if c in rows.columns]),
        contracts.NEIGHBORHOODS)


def seasonal_patterns(seasons: DataFrame, regions: DataFrame, year_of_analysis: int, days: DataFrame | None = None) -> DataFrame:
    """Price, volume and days indices per region and calendar month: month value over the mean of the months.

    ``days`` holds (region, city, sale_month, days) when listing dates are known; without it the index is 1.
    """
    rows = seasons.where(F.col("region").isNotNull())
    if days is not None:
        rows = rows.join(days, ["region", "city", "sale_month"], "left")
    else:
        rows = rows.withColumn("days", F.lit(1.0))
    whole = Window.partitionBy("region", "city")  # twelve rows per region
    indexed = rows.select(
        region_key().alias("region_name"), F.col("sale_month").alias("month"), F.col("seasonal_index").alias("price_index"),
        index_to_mean(F.col("monthly_sales"), F.avg("monthly_sales").over(whole)).alias("transaction_volume_index"),
        index_to_mean(F.col("days"), F.avg("days").over(whole)).alias("days_on_market_index"),
        F.lit(year_of_analysis).alias("year_of_analysis"))
    return contracts.conform(indexed.join(regions, "region_name"), contracts.SEASONAL)


def days_by_calendar_month(sales: DataFrame, default: int = DAYS_DEFAULT) -> DataFrame:
    """Mean days on market per region and calendar month."""
    days = F.coalesce(F.datediff("transaction_date", "listing_date"), F.lit(default))
    return sales.groupBy("region", "city", F.month("transaction_date").alias("sale_month")).agg(
        ratio(F.sum(days), F.count(days)).alias("days"))


def feature_importance(ranked: DataFrame) -> DataFrame:
    """Ranked features with a unique id in rank order."""
    order = Window.orderBy("importance_rank", "feature_name")  # one row per feature
    rows = ranked.select(
        F.row_number().over(order).alias("feature_id"), "feature_name", F.col("feature_type").alias("feature_category"),
        F.col("abs_correlation").alias("global_importance_score"), "correlation_with_price",
        F.lit(MODEL_VERSION).alias("model_version"))
    return contracts.conform(rows, contracts.FEATURE_IMPORTANCE)


def regional_variation(rows: DataFrame, numeric: list[str], features: DataFrame, regions: DataFrame) -> DataFrame:
    """Importance of each numeric feature in each region."""
    named = rows.withColumn("region_name", region_key())
    varied = importance.importance_by(named, ["region_name"], numeric)
    joined = varied.join(regions, "region_name").join(features.select("feature_id", "feature_name"), "feature_name")
    return contracts.conform(joined, contracts.REGIONAL_VARIATION)


def temporal_variation(rows: DataFrame, numeric: list[str], features: DataFrame) -> DataFrame:
    """Importance of each numeric feature in each quarter."""
    dated = rows.withColumns({"period_year": F.year("transaction_date"), "period_quarter": F.quarter("transaction_date")})
    varied = importance.importance_by(dated, ["period_year", "period_quarter"], numeric)
    joined = varied.join(features.select("feature_id", "feature_name"), "feature_name")
    return contracts.conform(joined, contracts.TEMPORAL_VARIATION)
