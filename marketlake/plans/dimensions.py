"""Four dimension tables from cleaned housing rows: property, location, building, sale history.

Each is one projection of the same rows; columns a source lacks get typed defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions import rules
from marketlake.functions.nulls import col_or


def property_id(df: DataFrame) -> Column:
    """``Id``, else ``id``, else a generated id."""
    for name in ("Id", "id"):
        if name in df.columns:
            return F.col(name)
    return F.monotonically_increasing_id()


def _stamps(df: DataFrame) -> list[Column]:
    return [col_or(df, "processing_timestamp", None, "timestamp"), col_or(df, "source_system", None, "string")]


def property_details(df: DataFrame, price_column: str | None = None) -> DataFrame:
    amount = rules.price(df, price_column)
    area = col_or(df, "LotArea", None, "double")
    return df.select(
        property_id(df).alias("property_id"),
        col_or(df, "MSSubClass", None, "string").alias("property_type"),
        amount.alias("price"), area.alias("surface"),
        col_or(df, "OverallCond", None, "string").alias("condition"),
        rules.energy_rating(df).alias("energy_rating"),
        rules.transaction_date(df).alias("transaction_date"), rules.listing_date(df).alias("listing_date"),
        *_stamps(df), col_or(df, "data_quality_score", None, "double"),
        rules.age_at_sale(col_or(df, "YrSold", None, "int"), col_or(df, "YearBuilt", None, "int")).alias("age_at_sale"),
        rules.price_per_area(amount, area).alias("price_per_sqft"),
        F.current_timestamp().alias("created_at"))


def location_details(df: DataFrame) -> DataFrame:
    longitude, latitude = rules.coordinates(df)
    return df.select(
        property_id(df).alias("property_id"), rules.address(df).alias("address"),
        F.lit(rules.CITY).alias("city"), F.lit(rules.POSTAL_CODE).alias("postal_code"), F.lit(rules.REGION).alias("region"),
        longitude.alias("longitude"), latitude.alias("latitude"),
        col_or(df, "Neighborhood", None, "string").alias("neighborhood"),
        col_or(df, "MSZoning", None, "string").alias("zoning_code"), col_or(df, "Street", None, "string").alias("street_type"),
        col_or(df, "LotConfig", None, "string").alias("lot_config"),
        col_or(df, "LandContour", None, "string").alias("land_contour"),
        rules.services_proximity(df).alias("services_proximity"),
        *_stamps(df), F.current_timestamp().alias("created_at"))


def building_features(df: DataFrame) -> DataFrame:
    return df.select(
        property_id(df).alias("property_id"), col_or(df, "BedroomAbvGr", None, "int").alias("bedrooms"),
        col_or(df, "TotRmsAbvGrd", None, "int").alias("rooms"), rules.bathrooms(df).alias("bathrooms"),
        rules.total_rooms(df).alias("total_rooms"), rules.floor_number(df).alias("floor_number"),
        rules.total_floors(df).alias("total_floors"), rules.garage(df).alias("garage"), F.lit(False).alias("parking"),
        rules.pool(df).alias("pool"), rules.garden(df).alias("garden"), rules.terrace(df).alias("terrace"),
        col_or(df, "Exterior1st", None, "string").alias("construction_material"), rules.roof_type(df).alias("roof_type"),
        col_or(df, "Heating", None, "string").alias("heating_system"), rules.cooling_system(df).alias("cooling_system"),
        *_stamps(df), F.current_timestamp().alias("created_at"))


def sale_history(df: DataFrame, price_column: str | None = None, previous_column: str | None = None) -> DataFrame:
    """``previous_column`` names a known earlier price; without one the fixed share of the price is assumed."""
    amount = rules.price(df, price_column)
    known = F.col(previous_column) if previous_column else None
    return df.select(
        property_id(df).alias("property_id"), rules.transaction_date(df).alias("transaction_date"),
        amount.alias("sale_price"), col_or(df, "SaleType", None, "string").alias("sale_type"),
        col_or(df, "SaleCondition", None, "string").alias("sale_condition"),
        rules.previous_price(amount, known).alias("previous_price"),
        rules.price_change_percentage(amount, known).alias("price_change_percentage"),
        rules.days_on_market_of(df).alias("days_on_market"), rules.seller_type(df).alias("seller_type"),
        rules.buyer_type(df).alias("buyer_type"), rules.financing_type(df).alias("financing_type"),
        *_stamps(df), F.current_timestamp().alias("created_at"))


def dimension_tables(df: DataFrame, price_column: str | None = None) -> dict[str, DataFrame]:
    return {
        "property_details": property_details(df, price_column),
        "location_details": location_details(df),
        "building_features": building_features(df),
        "sale_history": sale_history(df, price_column),
    }
