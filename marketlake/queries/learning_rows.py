"""Feature importance and feature columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.functions.numbers import haversine_km, planar_km
from marketlake.functions.rules import pseudo_coordinate
from marketlake.operators import features, importance, periods
from marketlake.plans import analytics
from marketlake.queries.base import LISTINGS, NEIGHBORHOOD, Family, exact_mean, r, rounded
from marketlake.sources.orders_market import listings_view, sales_view

family = Family()
NUMERIC = ["total_rooms", "bedrooms", "bathrooms", "has_pool"]
CATEGORICAL = ["property_type", "condition", "region", "city", "neighborhood", "roof_type"]


def feature_source(spark, folder):
    return listings_view(spark, folder).withColumn("has_pool", F.col("pool").cast("int"))


F_ROWS = LISTINGS + ", f as (select *, cast(pool as int) as has_pool from listings)"


def _corr(column: str) -> str:
    return f"corr({column}, price)"


@family.add("importance_correlation", f"with {F_ROWS} " + " union all ".join(
    f"select '{c}' as feature_name, {r(_corr(c), 6)} as correlation_with_price from f" for c in NUMERIC))
def importance_correlation(spark, folder):
    return rounded(importance.correlations(feature_source(spark, folder), NUMERIC, "price"), {"correlation_with_price": 6})


MEANS = " union all ".join(
    f"select '{c}' as feature_name, {c} as category, {exact_mean('price')} as avg_price, count(*) as property_count "
    f"from f group by {c}" for c in CATEGORICAL)


@family.add("importance_category_means", f"with {F_ROWS} {MEANS}")
def importance_category_means(spark, folder):
    return importance.category_means(feature_source(spark, folder), CATEGORICAL, "price", 2)


IMPACT = f"""means as ({MEANS}),
spread as (select feature_name, coalesce(var_samp(avg_price), 0) as price_variance, count(*) as category_count
           from means group by feature_name),
impact as (select *, price_variance / max(price_variance) over () as impact from spread)"""


@family.add("importance_category_impact", f"""
with {F_ROWS}, {IMPACT} select feature_name, {r('price_variance', 2)} as price_variance, category_count,
  {r('impact', 6)} as impact from impact""")
def importance_category_impact(spark, folder):
    means = importance.category_means(feature_source(spark, folder), CATEGORICAL, "price", 2)
    return rounded(importance.category_impact(means), {"price_variance": 2, "impact": 6})


RANKED = f"""{F_ROWS}, {IMPACT},
united as (
  {' union all '.join(f"select '{c}' as feature_name, {_corr(c)} as correlation_with_price, abs({_corr(c)}) as abs_correlation, 'numeric' as feature_type, cast(null as bigint) as category_count from f" for c in NUMERIC)}
  union all select feature_name, impact, impact, 'categorical', category_count from impact),
ranked as (select *, cast(dense_rank() over (order by abs_correlation desc) as int) as importance_rank from united)"""


def ranked_features(spark, folder):
    return importance.feature_importance(feature_source(spark, folder), NUMERIC, CATEGORICAL, money_scale=2)


@family.add("importance_ranked", f"""
with {RANKED} select feature_name, {r('correlation_with_price', 6)} as correlation_with_price,
  {r('abs_correlation', 6)} as abs_correlation, feature_type, category_count, importance_rank from ranked""")
def importance_ranked(spark, folder):
    return rounded(ranked_features(spark, folder), {"correlation_with_price": 6, "abs_correlation": 6})


def by_sql(by: list[str]) -> str:
    keys = ", ".join(by)
    return " union all ".join(
        f"select '{c}' as feature_name, {keys}, abs({_corr(c)}) as importance_score, "
        f"abs({_corr(c)}) / (select abs({_corr(c)}) from f) as relative_importance from f group by {keys}" for c in NUMERIC)


def _by(name: str, keys: list[str], columns) -> None:
    @family.add(name, f"""
with {F_ROWS.replace('as has_pool', 'as has_pool, cast(year(transaction_date) as int) as period_year, cast(quarter(transaction_date) as int) as period_quarter')}
select feature_name, {', '.join(keys)}, {r('importance_score', 6)} as importance_score,
  {r('relative_importance', 6)} as relative_importance from ({by_sql(keys)})""")
    def query(spark, folder):
        rows = feature_source(spark, folder).withColumns(columns())
        return rounded(importance.importance_by(rows, keys, NUMERIC), {"importance_score": 6, "relative_importance": 6})


_by("importance_by_region", ["region", "city"], dict)
_by("importance_by_quarter", ["period_year", "period_quarter"], lambda: {
    "period_year": F.year("transaction_date"), "period_quarter": F.quarter("transaction_date")})

# Values of the one-hot columns, known from the tables' own domains.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
ONE_HOT = {"property_type": PRIORITIES, "condition": STATUSES}


def _suffix(value: str) -> str:
    return value.replace(" ", "_").replace("-", "_").lower()


ONE_HOT_SQL = ", ".join(
    f"cast({c} is not null and {c} = '{v}' as int) as {c}_{_suffix(v)}" for c, values in ONE_HOT.items() for v in values)


@family.add("features_one_hot", f"""
with {LISTINGS} select property_id, property_type, condition, cast(pool as int) as pool, {ONE_HOT_SQL} from listings""")
def features_one_hot(spark, folder):
    """Category lists are discovered from the data in one job."""
    rows = listings_view(spark, folder).select(
        "property_id", "property_type", "condition", features.as_flag(F.col("pool")).alias("pool"))
    categories = features.category_lists(rows, ["property_type", "condition"])
    return rows.select("*", *features.one_hot(rows, categories))


@family.add("features_ratios", f"""
with {LISTINGS} select property_id, total_rooms / bedrooms as rooms_per_bedroom,
  case when bathrooms - 1 > 0 then total_rooms / (bathrooms - 1) else total_rooms end as rooms_per_bathroom from listings""")
def features_ratios(spark, folder):
    """One bathroom is taken off so that zero denominators occur."""
    return listings_view(spark, folder).select(
        "property_id", *features.room_ratios(F.col("total_rooms"), F.col("bedrooms"), F.col("bathrooms") - 1))


LON, LAT = "(-93.62 + (ascii(substr(neighborhood, 8, 1)) % 10) / 100.0)", "(42.03 + (ascii(substr(neighborhood, 9, 1)) % 10) / 100.0)"
PLANAR = f"sqrt(power({LON} + 93.62, 2) + power({LAT} - 42.03, 2)) * 111"


@family.add("features_distance", f"""
with {LISTINGS}, p as (select property_id, neighborhood, {LON} as lon, {LAT} as lat, {PLANAR} as planar from listings)
select property_id, neighborhood, {r('planar', 5)} as distance_to_downtown,
  {r('''2 * 6371.0 * asin(sqrt(power(sin(radians(lat - 42.03) / 2), 2)
    + cos(radians(lat)) * cos(radians(42.03)) * power(sin(radians(lon + 93.62) / 2), 2)))''', 5)} as great_circle_km from p""")
def features_distance(spark, folder):
    centre = (-93.62, 42.03)
    name = F.col("neighborhood")
    lon, lat = pseudo_coordinate(name, 8, centre[0]), pseudo_coordinate(name, 9, centre[1])
    rows = listings_view(spark, folder).select(
        "property_id", "neighborhood", planar_km(lon, lat, *centre).alias("distance_to_downtown"),
        haversine_km(lon, lat, *centre).alias("great_circle_km"))
    return rounded(rows, {"distance_to_downtown": 5, "great_circle_km": 5})


LEVELS = f"levels as (select neighborhood, sale_year, sale_month, avg_price, median_price from ({NEIGHBORHOOD}))"


@family.add("features_trend_ratio", f"""
with {LISTINGS}, {LEVELS}
select property_id, l.neighborhood, l.price as target_price, l.sale_year as transaction_year, l.sale_month as transaction_month,
  v.avg_price as neighborhood_avg_price, {r('v.median_price', 4)} as neighborhood_median_price,
  case when v.avg_price > 0 then l.price / v.avg_price else 1.0 end as price_to_neighborhood_ratio
from listings l left join levels v using (neighborhood, sale_year, sale_month)""")
def features_trend_ratio(spark, folder):
    trends = periods.period_stats(sales_view(spark, folder), grains=["neighborhood_monthly"])
    rows = listings_view(spark, folder).select(
        "property_id", "neighborhood", F.col("price").alias("target_price"),
        F.year("transaction_date").alias("transaction_year"), F.month("transaction_date").alias("transaction_month"))
    return rounded(features.with_neighborhood_trend(rows, trends), {"neighborhood_median_price": 4})


def feature_table(spark, folder):
    """The feature table of the market views, with fixed category lists."""
    sales = sales_view(spark, folder)
    trends = periods.period_stats(sales, grains=["neighborhood_monthly"])
    name = F.col("neighborhood")
    rows = listings_view(spark, folder).select(
        "property_id", F.col("price").alias("target_price"), "property_type", "condition", "transaction_date",
        "total_rooms", "bathrooms", "bedrooms", "roof_type", F.col("pool").alias("has_pool"), "region", "city", "neighborhood",
        pseudo_coordinate(name, 8, -93.62).alias("longitude"), pseudo_coordinate(name, 9, 42.03).alias("latitude"))
    return analytics.prediction_features(rows, trends, ONE_HOT)


@family.add("features_table", f"""
with {LISTINGS}, {LEVELS}
select property_id, l.price as target_price, property_type, condition, transaction_date, total_rooms, bathrooms, bedrooms,
  roof_type, cast(pool as int) as has_pool, region, city, l.neighborhood, {r(LON, 6)} as longitude, {r(LAT, 6)} as latitude,
  {ONE_HOT_SQL}, l.sale_year as transaction_year, l.sale_month as transaction_month,
  cast(quarter(transaction_date) as int) as transaction_quarter, total_rooms / bedrooms as rooms_per_bedroom,
  total_rooms / bathrooms as rooms_per_bathroom, {r(PLANAR.replace('neighborhood', 'l.neighborhood'), 5)} as distance_to_downtown,
  v.avg_price as neighborhood_avg_price, {r('v.median_price', 4)} as neighborhood_median_price,
  case when v.avg_price > 0 then l.price / v.avg_price else 1.0 end as price_to_neighborhood_ratio
from listings l left join levels v using (neighborhood, sale_year, sale_month)""".replace(
    "(ascii(substr(neighborhood", "(ascii(substr(l.neighborhood"))
def features_table(spark, folder):
    return rounded(feature_table(spark, folder), {
        "longitude": 6, "latitude": 6, "distance_to_downtown": 5, "neighborhood_median_price": 4})
