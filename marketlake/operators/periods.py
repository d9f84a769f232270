"""Price statistics per period and place, moving averages, coarser periods, seasonality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions.dates import first_of_month, month_name, quarter_label, season
from marketlake.functions.numbers import average, index_to_mean, steady_round
from marketlake.operators.grouped import summarize
from marketlake.roles import Roles

PLACE_COLUMNS = ("region", "city", "neighborhood", "property_type")
# Which columns each grain is keyed by; the other key columns are null in its rows.
GRAINS = {
    "monthly": ("region", "city", "sale_year", "sale_month"),
    "quarterly": ("region", "city", "sale_year", "sale_quarter"),
    "neighborhood_monthly": ("neighborhood", "sale_year", "sale_month"),
    "property_type_quarterly": ("property_type", "region", "city", "sale_year", "sale_quarter"),
}
MOVING = "moving_avg_3m"
PERIOD_KEYS = ("period_type", *PLACE_COLUMNS, "sale_year", "sale_quarter", "sale_month")
PRICE_COLUMNS = ("properties_sold", "avg_price", "price_stddev", "min_price", "max_price", "median_price")


def sale_rows(df: DataFrame, roles: Roles) -> DataFrame:
    """The role columns under standard names, with year, month and quarter of the sale."""
    date = F.col(roles.date)
    columns = [
        F.col(roles.id).alias("property_id"), F.col(roles.price).cast("double").alias("price"),
        F.col(roles.region).alias("region"), F.col(roles.city).alias("city"),
        F.col(roles.neighborhood).alias("neighborhood"), F.col(roles.kind).alias("property_type"),
        F.year(date).alias("sale_year"), F.month(date).alias("sale_month"), quarter_label(date).alias("sale_quarter")]
    if roles.unit_price:
        columns.append(F.col(roles.unit_price).cast("double").alias("unit_price"))
    return df.select(*columns)


def price_aggregates(roles: Roles) -> dict[str, Column]:
    aggregates = {
        "properties_sold": F.count("property_id"),
        "avg_price": average(F.col("price"), roles.money_scale),
        "price_stddev": F.stddev_samp("price"),
        "min_price": F.min("price"),
        "max_price": F.max("price"),
    }
    if roles.unit_price:
        aggregates["avg_unit_price"] = F.avg("unit_price")
    return aggregates


def _at_grains(rows: DataFrame, grains: list[str]) -> DataFrame:
    """Each sale once per grain, with the columns outside the grain set to null."""
    def key(grain: str, name: str) -> Column:
        if name == "period_type":
            return F.lit(grain).alias(name)
        source = F.col(name) if name in GRAINS[grain] else F.lit(None).cast(dict(rows.dtypes)[name])
        return source.alias(name)

    measures = [c for c in rows.columns if c not in PERIOD_KEYS]
    if len(grains) == 1:
        return rows.select(*measures, *[key(grains[0], k) for k in PERIOD_KEYS])
    copies = F.array(*[F.struct(*[key(g, k) for k in PERIOD_KEYS]) for g in grains])
    return rows.select(*measures, F.inline(copies))


def period_stats(sales: DataFrame, roles: Roles = Roles(), grains: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact median of the price at the chosen grains.

    All grains come from one read of the sales: rows are copied per grain and combined map-side.
    """
    rows = _at_grains(sale_rows(sales, roles), list(grains or GRAINS))
    stats = summarize(rows, list(PERIOD_KEYS), price_aggregates(roles), {"median_price": "price"})
    monthly = F.col("sale_quarter").isNull()
    return stats.withColumn(
        "period_value", F.when(monthly, F.col("sale_month").cast("string")).otherwise(F.col("sale_quarter")))


def moving_average(df: DataFrame, keys: list[str], value: str, rows: int, order=("sale_year", "sale_month")) -> Column:
    """Mean of the current and the ``rows - 1`` rows before it. Missing months are not filled in."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, Window.currentRow)
    return F.avg(value).over(window)


def price_trends(sales: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """The four grains plus, for each monthly row, a copy carrying the 3-row moving average.

    The average is a window on the aggregated months; the copy is made by exploding, so nothing is
    aggregated twice.
    """
    stats = period_stats(sales, roles)
    series = ["period_type", *PLACE_COLUMNS]
    averaged = stats.withColumn("__ma", moving_average(stats, series, "avg_price", 3))
    plain = F.struct(F.col("period_type").alias("t"), F.lit(None).cast("double").alias("ma"))
    moving = F.struct(F.lit(MOVING).alias("t"), F.col("__ma").alias("ma"))
    copies = F.when(F.col("period_type") == "monthly", F.array(plain, moving)).otherwise(F.array(plain))
    rest = [c for c in stats.columns if c != "period_type"]
    return averaged.select(*rest, F.inline(copies).alias("period_type", MOVING))


def moving_averages(trends: DataFrame) -> DataFrame:
    """3, 6 and 12 row averages per (region, city); 3 and 6 row averages of the mean per neighborhood."""
    rows = trends.where(F.col("period_type").isin("monthly", "neighborhood_monthly")).drop(MOVING)
    by_region = F.col("period_type") == "monthly"
    series = ["period_type", *PLACE_COLUMNS]

    def averaged(value: str, months: int) -> Column:
        return steady_round(moving_average(rows, series, value, months), 2)

    both = {f"avg_price_{m}m": averaged("avg_price", m) for m in (3, 6)}
    region_only = {"avg_price_12m": averaged("avg_price", 12)}
    region_only |= {f"median_price_{m}m": averaged("median_price", m) for m in (3, 6, 12)}
    return rows.select(
        "*", *[c.alias(n) for n, c in both.items()],
        *[F.when(by_region, c).alias(n) for n, c in region_only.items()],
        F.when(by_region, "region_city").otherwise("neighborhood").alias("moving_avg_type"))


def seasonal_variations(trends: DataFrame) -> DataFrame:
    """Calendar-month averages against the place's own mean, for (region, city) and for neighborhoods.

    Rows without a place drop out. The place mean is a window over at most twelve rows per place.
    """
    by_region = F.col("period_type") == "monthly"
    placed = F.when(by_region, F.col("region").isNotNull() & F.col("city").isNotNull()).otherwise(
        F.col("neighborhood").isNotNull())
    place = ["period_type", "region", "city", "neighborhood"]
    months = (
        trends.where(F.col("period_type").isin("monthly", "neighborhood_monthly") & placed)
        .groupBy(*place, "sale_month")
        .agg(F.avg("avg_price").alias("avg_monthly_price"), F.avg("median_price").alias("median_monthly_price"),
             F.sum("properties_sold").alias("monthly_sales"), F.count(F.lit(1)).alias("data_points")))
    whole = Window.partitionBy(*place)
    mean, median = F.avg("avg_monthly_price").over(whole), F.avg("median_monthly_price").over(whole)
    indexed = months.withColumn("__mean", mean).withColumn("__median", median)
    return indexed.select(
        "region", "city", "neighborhood", "sale_month", "avg_monthly_price", "median_monthly_price", "data_points",
        "monthly_sales",
        F.when(by_region, F.col("__mean")).alias("region_avg_price"),
        F.when(by_region, F.col("__median")).alias("region_median_price"),
        F.when(~by_region, F.col("__mean")).alias("neighborhood_avg_price"),
        F.when(~by_region, F.col("__median")).alias("neighborhood_median_price"),
        index_to_mean(F.col("avg_monthly_price"), F.col("__mean")).alias("seasonal_index"),
        index_to_mean(F.col("median_monthly_price"), F.col("__median")).alias("median_seasonal_index"),
        month_name(F.col("sale_month")).alias("month_name"), season(F.col("sale_month")).alias("season"))


def coarser_periods(series: DataFrame, unit: str, weighted: bool = False) -> DataFrame:
    """Regional monthly series by quarter or year: mean prices, total count, first date.

    Plain means of the monthly means are the default; ``weighted`` weighs them by the counts.
    """
    label = F.year("date").cast("string")
    if unit == "quarter":
        label = F.concat(label, F.lit("-Q"), F.quarter("date").cast("string"))

    def mean(name: str) -> Column:
        if weighted:
            return F.try_divide(F.sum(F.col(name) * F.col("transaction_count")),
                                F.sum("transaction_count").cast("double"))
        return F.avg(name)

    return series.groupBy("region_name", label.alias("period")).agg(
        mean("avg_price").alias("avg_price"), mean("median_price").alias("median_price"),
        F.sum("transaction_count").alias("transaction_count"), F.min("date").alias("date"))


def region_months(trends: DataFrame) -> DataFrame:
    """Monthly rows as a dated series per (region, city)."""
    return trends.where(F.col("period_type") == "monthly").withColumn(
        "date", first_of_month(F.col("sale_year"), F.col("sale_month")))
