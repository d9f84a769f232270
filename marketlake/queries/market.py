"""Market indicators, momentum and year-over-year change."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.operators import market, periods
from marketlake.operators.grouped import summarize
from marketlake.queries.base import MONTHLY, NEIGHBORHOOD, SALES, Family, exact_mean, r, r_all, rounded
from marketlake.sources.orders_market import sales_view

family = Family()


def indicators_sql(within_year: bool) -> str:
    """The CTE chain that ends in ``indicators``."""
    series = "neighborhood, sale_year" if within_year else "neighborhood"

    def pct(now, before):
        return f"case when {before} > 0 then {r(f'({now} - {before}) / {before} * 100', 2)} end"
    return f"""
dated as (select *, coalesce(date_diff('day', listing_date, transaction_date), 30) as days from sales),
monthly_market as (
  select neighborhood, sale_year, sale_month, count(property_id) as sales_volume,
    {exact_mean('price')} as avg_price, {exact_mean('days', 0)} as avg_days_on_market,
    quantile_cont(price, 0.5) as median_price, quantile_cont(cast(days as double), 0.5) as median_days_on_market
  from dated group by neighborhood, sale_year, sale_month),
lagged as (
  select *, lag(sales_volume) over w as prev_month_sales, lag(avg_price) over w as prev_month_price,
    lag(avg_days_on_market) over w as prev_month_days
  from monthly_market window w as (partition by {series} order by sale_year, sale_month)),
changed as (
  select *, 'neighborhood' as location_type,
    case when avg_days_on_market <> 0 then sales_volume / avg_days_on_market end as supply_demand_ratio,
    {pct('sales_volume', 'prev_month_sales')} as sales_volume_mom_pct,
    {pct('avg_price', 'prev_month_price')} as avg_price_mom_pct,
    {pct('avg_days_on_market', 'prev_month_days')} as days_on_market_mom_pct,
    case when avg_days_on_market > 0 then {r('sales_volume / avg_days_on_market * 100', 2)} else 0.0 end as market_heat_index
  from lagged),
indicators as (
  select *, case
    when sales_volume_mom_pct > 5 and avg_price_mom_pct > 2 then 'Marché en forte hausse'
    when sales_volume_mom_pct > 0 and avg_price_mom_pct > 0 then 'Marché en hausse'
    when sales_volume_mom_pct < -5 and avg_price_mom_pct < -2 then 'Marché en forte baisse'
    when sales_volume_mom_pct < 0 and avg_price_mom_pct < 0 then 'Marché en baisse'
    when days_on_market_mom_pct > 10 then 'Marché ralenti'
    when days_on_market_mom_pct < -10 then 'Marché accéléré'
    else 'Marché stable' end as market_status
  from changed)"""


DIGITS = {"median_price": 4, "median_days_on_market": 4, "supply_demand_ratio": 6}


def _add(name: str, within_year: bool) -> None:
    family.add(name, f"with {SALES}, {indicators_sql(within_year)} select * replace ({r_all(DIGITS)}) from indicators")(
        lambda spark, folder: rounded(
            market.market_indicators(sales_view(spark, folder, listing=True), within_year=within_year), DIGITS))


_add("market_indicators", False)
_add("market_indicators_within_year", True)


@family.add("market_indicators_by_city", f"""
with {SALES}, by_city as (
  select city, sale_year, sale_month, count(property_id) as sales_volume, {exact_mean('price')} as avg_price
  from sales group by city, sale_year, sale_month),
lagged as (select *, lag(sales_volume) over w as prev_month_sales, lag(avg_price) over w as prev_month_price
           from by_city window w as (partition by city order by sale_year, sale_month))
select *, 'city' as location_type, 30.0 as avg_days_on_market,
  case when prev_month_sales > 0 then {r('(sales_volume - prev_month_sales) / prev_month_sales * 100', 2)} end as sales_volume_mom_pct,
  {r('sales_volume / 30.0 * 100', 2)} as market_heat_index
from lagged""")
def market_indicators_by_city(spark, folder):
    """No neighborhood and no listing date: the city is the place and every sale took the default days."""
    sales = sales_view(spark, folder).drop("neighborhood")
    return market.market_indicators(sales).select(
        "city", "sale_year", "sale_month", "sales_volume", "avg_price", "prev_month_sales", "prev_month_price",
        "location_type", "avg_days_on_market", "sales_volume_mom_pct", "market_heat_index")


@family.add("market_momentum", f"""
with {SALES}, months as ({MONTHLY}),
lagged as (select *, lag(avg_price) over (partition by region, city order by sale_year, sale_month) as p from months)
select region, city, sale_year, sale_month, avg_price,
  case when p > 0 then {r('(avg_price - p) / p * 100', 2)} end as price_momentum from lagged""")
def market_momentum(spark, folder):
    months = periods.period_stats(sales_view(spark, folder), grains=["monthly"])
    return market.with_momentum(months, ["region", "city"]).select(
        "region", "city", "sale_year", "sale_month", "avg_price", "price_momentum")


@family.add("market_yoy", f"""
with {SALES}, months as ({NEIGHBORHOOD})
select a.neighborhood, a.sale_year, a.sale_month, a.avg_price,
  case when b.avg_price > 0 then {r('(a.avg_price - b.avg_price) / b.avg_price * 100', 2)} end as yoy_pct
from months a left join months b
  on a.neighborhood = b.neighborhood and a.sale_month = b.sale_month and a.sale_year = b.sale_year + 1""")
def market_yoy(spark, folder):
    months = periods.period_stats(sales_view(spark, folder), grains=["neighborhood_monthly"])
    return market.with_year_over_year(months, ["neighborhood"]).select(
        "neighborhood", "sale_year", "sale_month", "avg_price", "yoy_pct")


@family.add("market_median_by_region", """
select r_name as region, count(*) as properties_sold, avg(o_totalprice) as mean_price, quantile_cont(o_totalprice, 0.5) as median_price
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name
""".replace("avg(o_totalprice)", r("avg(o_totalprice)", 4)))
def market_median_by_region(spark, folder):
    """Few groups of many sales: the medians come from the second pass over the bracket around the middle."""
    summary = summarize(sales_view(spark, folder), ["region"], {
        "properties_sold": F.count("property_id"), "mean_price": F.avg("price")}, {"median_price": "price"})
    return rounded(summary, {"mean_price": 4})
