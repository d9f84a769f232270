"""Market indicators, momentum and year-over-year change on monthly aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions.dates import days_between_or
from marketlake.functions.numbers import average, pct_change, ratio, steady_round
from marketlake.operators.grouped import summarize
from marketlake.roles import Roles

DAYS_DEFAULT = 30  # fixed value: days on market when a date is missing
# Fixed values: (label, sales change, price change, sign) thresholds, first match wins.
STATUS_RULES = (
    ("Marché en forte hausse", 5, 2, 1), ("Marché en hausse", 0, 0, 1),
    ("Marché en forte baisse", -5, -2, -1), ("Marché en baisse", 0, 0, -1))
STATUS_SLOW, STATUS_FAST, STATUS_STABLE = "Marché ralenti", "Marché accéléré", "Marché stable"
DAYS_SWING = 10


def market_status(sales_pct: Column, price_pct: Column, days_pct: Column) -> Column:
    """Seven-way label; an unknown change matches no rule and ends as stable."""
    result = None
    for label, sales, price, sign in STATUS_RULES:
        hit = (sales_pct * sign > sales * sign) & (price_pct * sign > price * sign)
        result = F.when(hit, F.lit(label)) if result is None else result.when(hit, F.lit(label))
    return (
        result.when(days_pct > DAYS_SWING, F.lit(STATUS_SLOW))
        .when(days_pct < -DAYS_SWING, F.lit(STATUS_FAST)).otherwise(F.lit(STATUS_STABLE)))


def place_of(df: DataFrame, roles: Roles) -> tuple[str, str | None]:
    """Finest place the table knows: (location type, column)."""
    for kind in ("neighborhood", "city"):
        if getattr(roles, kind) in df.columns:
            return kind, getattr(roles, kind)
    return "global", None


def market_indicators(sales: DataFrame, roles: Roles = Roles(), within_year: bool = False) -> DataFrame:
    """Volume, prices, days on market, month-over-month changes, heat index and status.

    Months are compared along each place's whole series; ``within_year`` compares inside a calendar year
    only, so every January has no previous month.
    """
    location_type, column = place_of(sales, roles)
    place = [location_type] if column else []
    listed = F.col(roles.listing_date) if roles.listing_date in sales.columns else F.lit(None).cast("date")
    rows = sales.select(
        *([F.col(column).alias(location_type)] if column else []),
        F.col(roles.id).alias("property_id"), F.col(roles.price).cast("double").alias("price"),
        F.year(roles.date).alias("sale_year"), F.month(roles.date).alias("sale_month"),
        days_between_or(F.col(roles.date), listed, DAYS_DEFAULT).alias("days"))
    monthly = summarize(
        rows, [*place, "sale_year", "sale_month"],
        {"sales_volume": F.count("property_id"), "avg_price": average(F.col("price"), roles.money_scale),
         "avg_days_on_market": average(F.col("days"), 0)},
        {"median_price": "price", "median_days_on_market": "days"})
    series = place + (["sale_year"] if within_year else [])
    # Without a place the series has one row per month, so a window without partitions is small.
    before = Window.partitionBy(*series).orderBy("sale_year", "sale_month")
    previous = {"prev_month_sales": "sales_volume", "prev_month_price": "avg_price", "prev_month_days": "avg_days_on_market"}
    lagged = monthly.select("*", *[F.lag(source, 1).over(before).alias(name) for name, source in previous.items()])
    days, volume = F.col("avg_days_on_market"), F.col("sales_volume")
    changed = lagged.select(
        "*", ratio(volume, days).alias("supply_demand_ratio"), F.lit(location_type).alias("location_type"),
        pct_change(volume, F.col("prev_month_sales")).alias("sales_volume_mom_pct"),
        pct_change(F.col("avg_price"), F.col("prev_month_price")).alias("avg_price_mom_pct"),
        pct_change(days, F.col("prev_month_days")).alias("days_on_market_mom_pct"),
        F.when(days > 0, steady_round(ratio(volume, days) * F.lit(100.0), 2)).otherwise(F.lit(0.0)).alias("market_heat_index"))
    return changed.withColumn("market_status", market_status(
        F.col("sales_volume_mom_pct"), F.col("avg_price_mom_pct"), F.col("days_on_market_mom_pct")))


def with_momentum(months: DataFrame, keys: list[str], value: str = "avg_price", name: str = "price_momentum") -> DataFrame:
    """Percent change against the row before in each monthly series."""
    before = Window.partitionBy(*keys).orderBy("sale_year", "sale_month")
    return months.withColumn(name, pct_change(F.col(value), F.lag(value).over(before)))


def with_year_over_year(months: DataFrame, keys: list[str], value: str = "avg_price", name: str = "yoy_pct") -> DataFrame:
    """Percent change against the same calendar month one year earlier; null when that month is missing."""
    same_month = Window.partitionBy(*keys, "sale_month").orderBy("sale_year")
    has_last_year = F.lag("sale_year").over(same_month) == F.col("sale_year") - 1
    return months.withColumn(name, F.when(has_last_year, pct_change(F.col(value), F.lag(value).over(same_month))))
