"""Analytic tables from the dimension tables: trends, importance, model features, averages, seasons, indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.functions import rules
from marketlake.functions.numbers import planar_km
from marketlake.operators import features, importance, market, periods
from marketlake.roles import Roles

NUMERIC_FEATURES = ("total_rooms", "bathrooms", "bedrooms", "floor_number", "age_at_sale", "has_pool_int", "has_garden_int")
CATEGORICAL_FEATURES = ("property_type", "condition", "energy_rating", "neighborhood", "zoning_code", "roof_type")
ONE_HOT_COLUMNS = ("property_type", "condition", "energy_rating", "garage_type", "roof_style", "heating_type",
                   "cooling_type", "neighborhood", "zoning_code")


def sales_table(properties: DataFrame, locations: DataFrame) -> DataFrame:
    """Property and location on the property id, with the unit price where the properties have one."""
    unit = [c for c in ("price_per_sqft",) if c in properties.columns]
    return properties.select(
        "property_id", "price", "transaction_date", "listing_date", "property_type", *unit).join(
        locations.select("property_id", "region", "city", "neighborhood"), "property_id")


def importance_rows(properties: DataFrame, buildings: DataFrame, locations: DataFrame) -> DataFrame:
    """The three dimensions joined, with flags as numbers."""
    joined = (
        properties.select("property_id", "price", "property_type", "condition", "energy_rating", "age_at_sale")
        .join(buildings.select(
            "property_id", "total_rooms", "bathrooms", "bedrooms", "floor_number", "roof_type",
            F.col("garage").alias("garage_type"), F.col("pool").cast("int").alias("has_pool_int"),
            F.col("garden").cast("int").alias("has_garden_int")), "property_id")
        .join(locations.select("property_id", "neighborhood", "city", "zoning_code"), "property_id"))
    return joined.withColumn("total_sqft", F.col("total_rooms"))


def feature_importance(properties: DataFrame, buildings: DataFrame, locations: DataFrame) -> DataFrame:
    return importance.feature_importance(
        importance_rows(properties, buildings, locations), list(NUMERIC_FEATURES), list(CATEGORICAL_FEATURES))


def prediction_features(
    rows: DataFrame,
    trends: DataFrame | None = None,
    one_hot: dict[str, list] | None = None,
    flags: tuple[str, ...] = ("has_pool", "has_garden"),
    centre: tuple[float, float] = (rules.CENTRE_LONGITUDE, rules.CENTRE_LATITUDE),
) -> DataFrame:
    """Model features from joined rows: one-hot columns, 0/1 flags, date parts, ratios, distance, price level.

    ``one_hot`` fixes the category lists (so the schema is known before the run); steps whose columns are
    absent are left out.
    """
    have = set(rows.columns)
    extra = features.one_hot(rows, {c: v for c, v in (one_hot or {}).items() if c in have})
    if "transaction_date" in have:
        extra += features.time_parts(F.col("transaction_date"))
    if {"total_rooms", "bedrooms", "bathrooms"} <= have:
        extra += features.room_ratios(F.col("total_rooms"), F.col("bedrooms"), F.col("bathrooms"))
    if {"longitude", "latitude"} <= have:
        extra.append(planar_km(F.col("longitude"), F.col("latitude"), *centre).alias("distance_to_downtown"))
    kept = [features.as_flag(F.col(c)).alias(c) if c in flags else F.col(f"`{c}`") for c in rows.columns]
    table = rows.select(*kept, *extra)
    return features.with_neighborhood_trend(table, trends) if trends is not None else table


def feature_rows(properties: DataFrame, buildings: DataFrame, locations: DataFrame) -> DataFrame:
    """The columns the feature table starts from, out of the three dimensions."""
    return (
        properties.select("property_id", F.col("price").alias("target_price"), "property_type", "condition",
                          "energy_rating", "age_at_sale", "transaction_date")
        .join(buildings.select(
            "property_id", "total_rooms", "bathrooms", "bedrooms", F.col("floor_number").alias("floors"),
            F.col("garage").alias("garage_type"), F.col("roof_type").alias("roof_style"),
            F.col("pool").alias("has_pool"), F.col("garden").alias("has_garden"),
            F.col("heating_system").alias("heating_type"), F.col("cooling_system").alias("cooling_type")), "property_id")
        .join(locations.select("property_id", "neighborhood", "city", "zoning_code", "longitude", "latitude"), "property_id")
        .withColumn("total_sqft", F.col("total_rooms")))


def analytic_tables(dimensions: dict[str, DataFrame], roles: Roles = Roles()) -> dict[str, DataFrame]:
    """All six analytic tables. The one-hot lists cost one job; everything else is lazy."""
    properties, locations, buildings = (
        dimensions[n] for n in ("property_details", "location_details", "building_features"))
    sales = sales_table(properties, locations)
    trends = periods.price_trends(sales, roles)
    rows = feature_rows(properties, buildings, locations)
    return {
        "price_trends": trends,
        "feature_importance": feature_importance(properties, buildings, locations),
        "price_prediction_features": prediction_features(
            rows, trends, features.category_lists(rows, list(ONE_HOT_COLUMNS))),
        "moving_averages": periods.moving_averages(trends),
        "seasonal_variations": periods.seasonal_variations(trends),
        "market_indicators": market.market_indicators(sales, roles),
    }


def stamped(df: DataFrame, source_table: str, run_date) -> DataFrame:
    """Generation time, source names and the run's date parts. The run date is a parameter, so runs repeat."""
    return df.withColumns({
        "generated_at": F.current_timestamp(), "source_table": F.lit(source_table),
        "year": F.lit(run_date.year), "month": F.lit(run_date.month), "day": F.lit(run_date.day)})
