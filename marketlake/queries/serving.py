"""Serving results over the mart tables, with and without filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from marketlake.operators.importance import importance_by
from marketlake.plans import serving
from marketlake.plans.serving import Filters
from marketlake.queries import marts as m
from marketlake.queries.base import Family, r, rounded
from marketlake.queries.stored import stored
from marketlake.queries.trends import SEASONAL_NAMES

family = Family()
BUILDERS = {b.__name__: b for b in (
    m.regional_mart, m.neighborhood_mart, m.seasonal_mart, m.feature_mart, m.regional_variation_mart, m.temporal_variation_mart)}
ONE_REGION = "ASIA/NATION_7"
WINDOW = (date(1996, 3, 15), date(1999, 9, 10))
IN_WINDOW = "make_date(period_year, period_month, 1) between date '1996-03-15' and date '1999-09-10'"


def mart(spark, folder, name):
    """A stored mart, built on first use."""
    return stored(spark, folder, name, BUILDERS[name])


@family.add("serving_regions", f"with {m.REGIONAL_CTES} select distinct region_name from regional_mart")
def serving_regions(spark, folder):
    return serving.regions(mart(spark, folder, "regional_mart"))


@family.add("serving_neighborhoods", f"with {m.NEIGHBORHOOD_CTES} select neighborhood_name from neighborhood_mart")
def serving_neighborhoods(spark, folder):
    return serving.neighborhoods(mart(spark, folder, "neighborhood_mart"), mart(spark, folder, "regional_mart"))


@family.add("serving_neighborhoods_of_region", f"""
with {m.NEIGHBORHOOD_CTES} select neighborhood_name from neighborhood_mart
where region_id in (select region_id from region_ids where region_name = '{ONE_REGION}')""")
def serving_neighborhoods_of_region(spark, folder):
    return serving.neighborhoods(mart(spark, folder, "neighborhood_mart"), mart(spark, folder, "regional_mart"), ONE_REGION)


@family.add("serving_date_range", f"""
with {m.REGIONAL_CTES} select min(make_date(period_year, period_month, 1)) as min_date,
  max(make_date(period_year, period_month, 1)) as max_date from regional_mart""")
def serving_date_range(spark, folder):
    return serving.date_range(mart(spark, folder, "regional_mart"))


def _by_region(condition: str, weighted: bool = False) -> str:
    def mean(c):
        if weighted:
            return r(f"sum(cast({c} as double) * transaction_count) / sum(transaction_count)", 4)
        return r(f"avg(cast({c} as double))", 4)
    return f"""with {m.REGIONAL_CTES} select region_name, region_id, {mean('avg_price')} as avg_price,
      {mean('median_price')} as median_price, max(max_price) as max_price, min(min_price) as min_price,
      cast(sum(transaction_count) as bigint) as total_transactions from regional_mart where {condition}
      group by region_name, region_id"""


PRICE_DIGITS = {"avg_price": 4, "median_price": 4}


@family.add("serving_price_by_region", _by_region("true"))
def serving_price_by_region(spark, folder):
    return rounded(serving.price_by_region(mart(spark, folder, "regional_mart")), PRICE_DIGITS)


@family.add("serving_price_by_region_filtered", _by_region(f"{IN_WINDOW} and region_name = '{ONE_REGION}'"))
def serving_price_by_region_filtered(spark, folder):
    filters = Filters(region=ONE_REGION, start=WINDOW[0], end=WINDOW[1])
    return rounded(serving.price_by_region(mart(spark, folder, "regional_mart"), filters), PRICE_DIGITS)


@family.add("serving_price_by_region_weighted", _by_region("true", weighted=True))
def serving_price_by_region_weighted(spark, folder):
    return rounded(serving.price_by_region(mart(spark, folder, "regional_mart"), weighted=True), PRICE_DIGITS)


@family.add("serving_price_trends", f"""
with {m.REGIONAL_CTES} select region_name, period_year, period_month, make_date(period_year, period_month, 1) as date,
  avg_price, median_price, transaction_count from regional_mart where {IN_WINDOW}""")
def serving_price_trends(spark, folder):
    return serving.price_series(mart(spark, folder, "regional_mart"), Filters(start=WINDOW[0], end=WINDOW[1]))


@family.add("serving_price_trends_all", f"""
with {m.REGIONAL_CTES} select region_name, period_year, period_month, make_date(period_year, period_month, 1) as date,
  avg_price, median_price, transaction_count from regional_mart""")
def serving_price_trends_all(spark, folder):
    return serving.price_series(mart(spark, folder, "regional_mart"), Filters())


@family.add("serving_features", f"""
with {m.FEATURE_CTES} select feature_id, feature_name, feature_category, global_importance_score, correlation_with_price
from feature_mart""")
def serving_features(spark, folder):
    return serving.feature_list(mart(spark, folder, "feature_mart"))


@family.add("serving_features_of_category", f"""
with {m.FEATURE_CTES} select feature_id, feature_name, feature_category, global_importance_score, correlation_with_price
from feature_mart where feature_category = 'numeric'""")
def serving_features_of_category(spark, folder):
    return serving.feature_list(mart(spark, folder, "feature_mart"), "numeric")


@family.add("serving_regional_variation", f"""
with {m.REGIONAL_VARIATION_CTES} select feature_name, region_name, importance_score, relative_importance
from regional_variation_mart join feature_mart using (feature_id) join region_ids using (region_id)""")
def serving_regional_variation(spark, folder):
    found = serving.regional_variation(
        mart(spark, folder, "regional_variation_mart"), mart(spark, folder, "feature_mart"), mart(spark, folder, "regional_mart"))
    return rounded(found, {"relative_importance": 6})


@family.add("serving_temporal_variation", f"""
with {m.TEMPORAL_VARIATION_CTES} select feature_name, period_year, period_quarter,
  period_year || '-Q' || period_quarter as period, importance_score
from temporal_variation_mart join feature_mart using (feature_id)
where period_year between 1996 and 1999""")
def serving_temporal_variation(spark, folder):
    return serving.temporal_variation(
        mart(spark, folder, "temporal_variation_mart"), mart(spark, folder, "feature_mart"), Filters(start=WINDOW[0], end=WINDOW[1]))


@family.add("serving_temporal_variation_all", f"""
with {m.TEMPORAL_VARIATION_CTES} select feature_name, period_year, period_quarter,
  period_year || '-Q' || period_quarter as period, importance_score
from temporal_variation_mart join feature_mart using (feature_id)""")
def serving_temporal_variation_all(spark, folder):
    return serving.temporal_variation(mart(spark, folder, "temporal_variation_mart"), mart(spark, folder, "feature_mart"), Filters())


COMPARISON = """neighborhood_id, neighborhood_name, city_name, region_name, avg_price, price_per_sqft, price_change_yoy,
  avg_days_on_market, walkability_score, school_rating, crime_index"""


@family.add("serving_neighborhood_comparison", f"""
with {m.NEIGHBORHOOD_CTES} select {COMPARISON} from neighborhood_mart join region_ids using (region_id)""")
def serving_neighborhood_comparison(spark, folder):
    return serving.neighborhood_comparison(mart(spark, folder, "neighborhood_mart"), mart(spark, folder, "regional_mart"))


@family.add("serving_neighborhood_comparison_filtered", f"""
with {m.NEIGHBORHOOD_CTES} select {COMPARISON} from neighborhood_mart join region_ids using (region_id)
where region_name = '{ONE_REGION}'""")
def serving_neighborhood_comparison_filtered(spark, folder):
    return serving.neighborhood_comparison(
        mart(spark, folder, "neighborhood_mart"), mart(spark, folder, "regional_mart"), Filters(region=ONE_REGION))


@family.add("serving_seasonal", f"""
with {m.SEASONAL_CTES} select region_name, month, {SEASONAL_NAMES.split(' as month_name')[0].replace('sale_month', 'month')} as month_name,
  price_index, transaction_volume_index, days_on_market_index, year_of_analysis
from seasonal_mart join region_ids using (region_id)""")
def serving_seasonal(spark, folder):
    return serving.seasonal_patterns(mart(spark, folder, "seasonal_mart"), mart(spark, folder, "regional_mart"))


QUALITY = "(cast(walkability_score as double) + cast(school_rating as double) + (10 - cast(crime_index as double))) / 3"


@family.add("serving_value_index", f"""
with {m.NEIGHBORHOOD_CTES} select neighborhood_name, {r(QUALITY, 6)} as quality_score, price_per_sqft,
  {r(f'{QUALITY} / nullif(cast(price_per_sqft as double), 0) * 10000', 6)} as value_index from neighborhood_mart""")
def serving_value_index(spark, folder):
    return rounded(serving.value_index(mart(spark, folder, "neighborhood_mart")), {"quality_score": 6, "value_index": 6})


NORMS = ("avg_price", "walkability_score", "crime_index")


@family.add("serving_normalised", f"""
with {m.NEIGHBORHOOD_CTES}, d as (select neighborhood_name, cast(avg_price as double) as avg_price,
  cast(walkability_score as double) as walkability_score, cast(crime_index as double) as crime_index from neighborhood_mart)
select *, {r('avg_price / max(avg_price) over () * 10', 6)} as avg_price_norm,
  {r('walkability_score / max(walkability_score) over () * 10', 6)} as walkability_score_norm,
  {r('10 - crime_index / max(crime_index) over () * 10', 6)} as crime_index_norm from d""")
def serving_normalised(spark, folder):
    rows = mart(spark, folder, "neighborhood_mart").select("neighborhood_name", *[F.col(c).cast("double").alias(c) for c in NORMS])
    return rounded(serving.scaled_to_ten(rows, NORMS, inverted=["crime_index"]), {f"{c}_norm": 6 for c in NORMS})


@family.add("serving_price_ratio", f"""
with {m.REGIONAL_CTES}, d as (select region_name, avg(cast(avg_price as double)) as avg_price from regional_mart group by region_name)
select region_name, {r('avg_price', 4)} as avg_price,
  {r('(avg_price - min(avg_price) over ()) / (max(avg_price) over () - min(avg_price) over ())', 6)} as price_ratio from d""")
def serving_price_ratio(spark, folder):
    rows = serving.price_by_region(mart(spark, folder, "regional_mart")).select("region_name", "avg_price")
    return rounded(serving.min_max_ratio(rows, "avg_price"), {"avg_price": 4, "price_ratio": 6})


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PIVOT_CELLS = ", ".join(f"first(v) filter (region = '{g}') as \"{g}\"" for g in REGIONS)


def _matrix_source(spark, folder):
    varied = importance_by(m.lr.feature_source(spark, folder), ["region"], m.lr.NUMERIC)
    return varied.withColumnRenamed("region", "region_name")


@family.add("serving_pivot", f"""
with {m.lr.F_ROWS}, v as ({m.lr.by_sql(['region'])}),
n as (select feature_name, region, relative_importance / avg(relative_importance) over (partition by feature_name) as v from v),
p as (select feature_name, {PIVOT_CELLS} from n group by feature_name)
select feature_name, {', '.join(f'{r(chr(34) + g + chr(34), 6)} as "{g}"' for g in REGIONS)} from p""")
def serving_pivot(spark, folder):
    """The column list comes from the region table, so the schema is known before the run."""
    names = [row.r_name for row in spark.read.parquet(f"{folder}/region.parquet").select("r_name").orderBy("r_name").collect()]
    matrix = serving.feature_matrix(_matrix_source(spark, folder), names)
    return rounded(matrix, {g: 6 for g in names})


@family.add("serving_unpivot", f"""
with {m.REGIONAL_CTES}, b as (select region_name, {r('avg(cast(avg_price as double))', 4)} as a,
  {r('avg(cast(median_price as double))', 4)} as d from regional_mart group by region_name)
select region_name, 'avg_price' as measure, a as price from b union all select region_name, 'median_price', d from b""")
def serving_unpivot(spark, folder):
    return rounded(serving.price_measures_long(serving.price_by_region(mart(spark, folder, "regional_mart"))), {"price": 4})


@family.add("serving_top_k", f"""
with {m.NEIGHBORHOOD_CTES} select neighborhood_name, avg_price from neighborhood_mart
order by avg_price desc, neighborhood_name limit 10""")
def serving_top_k(spark, folder):
    best = serving.top(mart(spark, folder, "neighborhood_mart"), 10, F.col("avg_price"), "neighborhood_name")
    return best.select("neighborhood_name", "avg_price")


@family.add("serving_top_correlations", f"""
with {m.FEATURE_CTES} select feature_id, feature_name, correlation_with_price from feature_mart
order by abs(correlation_with_price) desc, feature_id limit 5""")
def serving_top_correlations(spark, folder):
    best = serving.top(mart(spark, folder, "feature_mart"), 5, F.abs("correlation_with_price"), "feature_id")
    return best.select("feature_id", "feature_name", "correlation_with_price")
