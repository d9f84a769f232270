"""Period statistics, moving averages, seasonality, coarser periods and trend lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.operators import periods
from marketlake.operators.history import series_change, trend_line
from marketlake.queries.base import (
    MONTHLY, NEIGHBORHOOD, QUARTERLY, SALES, TRENDS, TYPE_QUARTERLY, Family, r, r_all, rounded)
from marketlake.sources.orders_market import sales_view

family = Family()
STATS_DIGITS = {"price_stddev": 2, "median_price": 4}


def _stats_sql(grain: str) -> str:
    return (f"with {SALES} select * replace ({r_all(STATS_DIGITS)}) from ({grain})")


def _grain(name: str, grain: str, sql: str) -> None:
    family.add(name, _stats_sql(sql))(
        lambda spark, folder: rounded(
            periods.period_stats(sales_view(spark, folder), grains=[grain]), STATS_DIGITS))


_grain("trends_monthly", "monthly", MONTHLY)
_grain("trends_quarterly", "quarterly", QUARTERLY)
_grain("trends_neighborhood_monthly", "neighborhood_monthly", NEIGHBORHOOD)
_grain("trends_type_quarterly", "property_type_quarterly", TYPE_QUARTERLY)


@family.add("trends_union", f"""
with {SALES}, {TRENDS}
select * replace ({r_all(STATS_DIGITS | {"moving_avg_3m": 4})}) from trends""")
def trends_union(spark, folder):
    return rounded(periods.price_trends(sales_view(spark, folder)), STATS_DIGITS | {"moving_avg_3m": 4})


def _monthly_grains(spark, folder):
    """Only the grains that averages and seasons read."""
    return periods.period_stats(sales_view(spark, folder), grains=["monthly", "neighborhood_monthly"])


@family.add("trends_moving_averages", f"""
with {SALES}, {TRENDS}
select * exclude (moving_avg_3m) replace ({r_all(STATS_DIGITS)}),
  {r("avg(avg_price) over w3", 2)} as avg_price_3m, {r("avg(avg_price) over w6", 2)} as avg_price_6m,
  {r("avg(avg_price) over w12", 2)} as avg_price_12m, {r("avg(median_price) over w3", 2)} as median_price_3m,
  {r("avg(median_price) over w6", 2)} as median_price_6m, {r("avg(median_price) over w12", 2)} as median_price_12m,
  'region_city' as moving_avg_type
from trends where period_type = 'monthly'
window w3 as (partition by region, city order by sale_year, sale_month rows 2 preceding),
       w6 as (partition by region, city order by sale_year, sale_month rows 5 preceding),
       w12 as (partition by region, city order by sale_year, sale_month rows 11 preceding)
union all
select * exclude (moving_avg_3m) replace ({r_all(STATS_DIGITS)}),
  {r("avg(avg_price) over n3", 2)}, {r("avg(avg_price) over n6", 2)}, null, null, null, null, 'neighborhood'
from trends where period_type = 'neighborhood_monthly'
window n3 as (partition by neighborhood order by sale_year, sale_month rows 2 preceding),
       n6 as (partition by neighborhood order by sale_year, sale_month rows 5 preceding)""")
def trends_moving_averages(spark, folder):
    return rounded(periods.moving_averages(_monthly_grains(spark, folder)), STATS_DIGITS)


SEASONAL_NAMES = """['Janvier','Février','Mars','Avril','Mai','Juin','Juillet','Août','Septembre','Octobre',
  'Novembre','Décembre'][sale_month] as month_name,
  case when sale_month between 3 and 5 then 'Printemps' when sale_month between 6 and 8 then 'Été'
       when sale_month between 9 and 11 then 'Automne' else 'Hiver' end as season"""

SEASONAL = f"""
season_months as (
  select period_type, region, city, neighborhood, sale_month, avg(avg_price) as avg_monthly_price,
         avg(median_price) as median_monthly_price, cast(sum(properties_sold) as bigint) as monthly_sales,
         count(*) as data_points
  from trends where period_type in ('monthly', 'neighborhood_monthly') group by all),
season_means as (
  select *, avg(avg_monthly_price) over p as m, avg(median_monthly_price) over p as md
  from season_months window p as (partition by period_type, region, city, neighborhood)),
seasonal as (
  select region, city, neighborhood, sale_month, avg_monthly_price, median_monthly_price, data_points, monthly_sales,
    case when period_type = 'monthly' then m end as region_avg_price,
    case when period_type = 'monthly' then md end as region_median_price,
    case when period_type <> 'monthly' then m end as neighborhood_avg_price,
    case when period_type <> 'monthly' then md end as neighborhood_median_price,
    case when m > 0 then {r("avg_monthly_price / m", 4)} else 1.0 end as seasonal_index,
    case when md > 0 then {r("median_monthly_price / md", 4)} else 1.0 end as median_seasonal_index,
    {SEASONAL_NAMES}
  from season_means)"""

SEASONAL_DIGITS = {c: 4 for c in (
    "avg_monthly_price", "median_monthly_price", "region_avg_price", "region_median_price",
    "neighborhood_avg_price", "neighborhood_median_price")}


@family.add("trends_seasonal", f"""
with {SALES}, {TRENDS}, {SEASONAL}
select * replace ({r_all(SEASONAL_DIGITS)}) from seasonal""")
def trends_seasonal(spark, folder):
    return rounded(periods.seasonal_variations(_monthly_grains(spark, folder)), SEASONAL_DIGITS)


def _regional_series(spark, folder):
    """Monthly rows per (region, city) under the serving names."""
    months = periods.period_stats(sales_view(spark, folder), grains=["monthly"])
    return periods.region_months(months).select(
        F.concat_ws("/", "region", "city").alias("region_name"), "date", "avg_price", "median_price",
        F.col("properties_sold").alias("transaction_count"))


REGIONAL_SERIES = f"""
series as (select region || '/' || city as region_name, make_date(sale_year, sale_month, 1) as date, avg_price,
                  median_price, properties_sold as transaction_count from ({MONTHLY}))"""


def _coarser_sql(label: str, weighted: bool) -> str:
    def mean(c):
        return f"sum({c} * transaction_count) / sum(transaction_count)" if weighted else f"avg({c})"
    return (f"select region_name, {label} as period, {r(mean('avg_price'), 4)} as avg_price, "
            f"{r(mean('median_price'), 4)} as median_price, cast(sum(transaction_count) as bigint) as transaction_count, "
            f"min(date) as date from series group by region_name, period")


@family.add("trends_reaggregate", f"""
with {SALES}, {REGIONAL_SERIES}
{_coarser_sql("year(date) || '-Q' || quarter(date)", False)} union all {_coarser_sql("cast(year(date) as varchar)", False)}""")
def trends_reaggregate(spark, folder):
    series = _regional_series(spark, folder)
    both = periods.coarser_periods(series, "quarter").unionByName(periods.coarser_periods(series, "year"))
    return rounded(both, {"avg_price": 4, "median_price": 4})


@family.add("trends_reaggregate_weighted", f"""
with {SALES}, {REGIONAL_SERIES}
{_coarser_sql("year(date) || '-Q' || quarter(date)", True)}""")
def trends_reaggregate_weighted(spark, folder):
    quarters = periods.coarser_periods(_regional_series(spark, folder), "quarter", weighted=True)
    return rounded(quarters, {"avg_price": 4, "median_price": 4})


@family.add("trends_total_variation", f"""
with {SALES}, {REGIONAL_SERIES}
select region_name, arg_min(avg_price, date) as first_value, arg_max(avg_price, date) as last_value,
  {r("(arg_max(avg_price, date) - arg_min(avg_price, date)) / arg_min(avg_price, date) * 100", 6)} as variation_pct
from series group by region_name""")
def trends_total_variation(spark, folder):
    return rounded(series_change(_regional_series(spark, folder), ["region_name"], "date", "avg_price"), {"variation_pct": 6})


@family.add("trends_regression", f"""
with {SALES}, {REGIONAL_SERIES},
indexed as (select *, row_number() over (partition by region_name order by date) - 1 as position from series),
lines as (select region_name, regr_slope(avg_price, position) as slope, regr_intercept(avg_price, position) as intercept
          from indexed group by region_name)
select region_name, date, avg_price, position, {r("slope", 4)} as slope, {r("intercept", 4)} as intercept,
       {r("intercept + slope * position", 4)} as fitted
from indexed join lines using (region_name)""")
def trends_regression(spark, folder):
    lined = trend_line(_regional_series(spark, folder), ["region_name"], ["date"], "avg_price")
    columns = ("region_name", "date", "avg_price", "position", "slope", "intercept", "fitted")
    return rounded(lined.select(*columns), {"slope": 4, "intercept": 4, "fitted": 4})
