"""The mart tables, their keys, and the warehouse views."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.operators import importance, market, periods
from marketlake.plans import marts, warehouse
from marketlake.queries import learning_rows as lr
from marketlake.queries.base import LISTINGS, Family, exact_mean, grain_sql, r, rounded
from marketlake.queries.market import indicators_sql
from marketlake.queries.stored import stored
from marketlake.queries.trends import SEASONAL
from marketlake.sources import contracts
from marketlake.sources.orders_market import UNIT_ROLES, listings_view, neighborhood_scores

family = Family()
STAMPS = ("created_at", "last_updated", "updated_at")
YEAR = 2001


def source(spark, folder):
    """The joined sales every mart starts from, stored once as a layered run would."""
    return stored(spark, folder, "listings", lambda spark, folder: listings_view(spark, folder, listing=True))


def feature_source(spark, folder):
    return source(spark, folder).withColumn("has_pool", F.col("pool").cast("int"))


def region_ids(sales):
    return marts.region_dictionary(sales)


def regional_mart(spark, folder):
    sales = source(spark, folder)
    months = periods.period_stats(sales, UNIT_ROLES, ["monthly"])
    return marts.regional_trends(months, region_ids(sales))


def neighborhood_mart(spark, folder):
    sales = source(spark, folder)
    months = periods.period_stats(sales, UNIT_ROLES, ["neighborhood_monthly"])
    return marts.neighborhood_comparison(
        months, market.market_indicators(sales), sales, region_ids(sales), neighborhood_scores(spark, folder))


def seasonal_mart(spark, folder):
    sales = source(spark, folder)
    months = periods.period_stats(sales, UNIT_ROLES, ["monthly"])
    return marts.seasonal_patterns(
        periods.seasonal_variations(months), region_ids(sales), YEAR, marts.days_by_calendar_month(sales))


def feature_mart(spark, folder):
    return marts.feature_importance(importance.feature_importance(
        feature_source(spark, folder), lr.NUMERIC, lr.CATEGORICAL, money_scale=2))


def regional_variation_mart(spark, folder):
    rows = feature_source(spark, folder)
    return marts.regional_variation(rows, lr.NUMERIC, feature_mart(spark, folder), region_ids(rows))


def temporal_variation_mart(spark, folder):
    return marts.temporal_variation(feature_source(spark, folder), lr.NUMERIC, feature_mart(spark, folder))


def dec(expression: str, precision: int, scale: int) -> str:
    return f"cast(round(cast({expression} as decimal(30,8)), {scale}) as decimal({precision},{scale}))"


def steady_mean(column: str) -> str:
    """The SQL form of ``numbers.steady_mean``."""
    return f"(cast(sum(cast({column} as decimal(30,8))) as double) / count({column}))"


MONTHLY_L = grain_sql("monthly", ("region", "city", "sale_year", "sale_month"), ", avg(unit_price) as avg_unit_price", "listings")
NEIGHBORHOOD_L = grain_sql("neighborhood_monthly", ("neighborhood", "sale_year", "sale_month"),
                           ", avg(unit_price) as avg_unit_price", "listings")
REGION_IDS = """region_ids as (select region_name, cast(row_number() over (order by region_name) as int) as region_id
  from (select distinct region || '/' || city as region_name from listings))"""

REGIONAL_MART = f"""{REGION_IDS}, months as ({MONTHLY_L}),
lagged as (select *, lag(avg_price) over (partition by region, city order by sale_year, sale_month) as p from months),
moved as (select *, case when p > 0 then {r('(avg_price - p) / p * 100', 2)} end as momentum from lagged),
regional_mart as (
  select region_id, region_name, sale_year as period_year, sale_month as period_month, {dec('avg_price', 12, 2)} as avg_price,
    {dec('median_price', 12, 2)} as median_price, {dec('min_price', 12, 2)} as min_price, {dec('max_price', 12, 2)} as max_price,
    {dec('momentum', 12, 2)} as price_momentum, cast(properties_sold as int) as transaction_count
  from moved join region_ids on region_name = region || '/' || city)"""

SCORES = """scores as (
  select neighborhood, sum(l_quantity) / count(*) / 5 as walkability_score,
    cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*) * 100 as school_rating,
    cast(sum(cast(l_tax as decimal(18,2))) as double) / count(*) * 100 as crime_index
  from lineitem join sales on l_orderkey = property_id group by neighborhood)"""

NEIGHBORHOOD_MART = f"""{indicators_sql(False).replace('from sales', 'from listings')},
n_months as ({NEIGHBORHOOD_L}),
n_changed as (
  select a.*, case when b.avg_price > 0 then {r('(a.avg_price - b.avg_price) / b.avg_price * 100', 2)} end as yoy
  from n_months a left join n_months b on a.neighborhood = b.neighborhood and a.sale_month = b.sale_month
    and a.sale_year = b.sale_year + 1),
n_prices as (
  select neighborhood, {steady_mean('avg_price')} as avg_price, {steady_mean('avg_unit_price')} as unit,
    arg_max(yoy, case when yoy is not null then sale_year * 100 + sale_month end) as yoy from n_changed group by neighborhood),
n_days as (select neighborhood, {steady_mean('avg_days_on_market')} as days from indicators group by neighborhood),
n_places as (select neighborhood, min(city) as city, min(region || '/' || city) as region_name from listings group by neighborhood),
{SCORES},
neighborhood_mart as (
  select cast(row_number() over (order by neighborhood) as int) as neighborhood_id, neighborhood as neighborhood_name,
    city as city_name, region_id, {dec('avg_price', 12, 2)} as avg_price, {dec('unit', 8, 2)} as price_per_sqft,
    coalesce({dec('yoy', 12, 2)}, 0) as price_change_yoy, cast({r('days', 0)} as int) as avg_days_on_market,
    {dec('walkability_score', 4, 1)} as walkability_score, {dec('school_rating', 4, 1)} as school_rating,
    {dec('crime_index', 4, 1)} as crime_index
  from n_prices join n_days using (neighborhood) join n_places using (neighborhood) join scores using (neighborhood)
  join region_ids using (region_name))"""

SEASONAL_MART = f"""trends as ({MONTHLY_L}), {SEASONAL},
month_days as (
  select region, city, sale_month, sum(coalesce(date_diff('day', listing_date, transaction_date), 30)) / count(*) as days
  from listings group by all),
seasonal_mart as (
  select region_id, sale_month as month, {dec('seasonal_index', 5, 2)} as price_index,
    {dec(r('monthly_sales / avg(monthly_sales) over p', 4), 5, 2)} as transaction_volume_index,
    {dec(r('days / avg(days) over p', 4), 5, 2)} as days_on_market_index, {YEAR} as year_of_analysis
  from seasonal join month_days using (region, city, sale_month) join region_ids on region_name = region || '/' || city
  window p as (partition by region, city))"""

FEATURE_MART = f"""feature_mart as (
  select cast(row_number() over (order by importance_rank, feature_name) as int) as feature_id, feature_name,
    feature_type as feature_category, {dec('abs_correlation', 5, 2)} as global_importance_score,
    {dec('correlation_with_price', 4, 3)} as correlation_with_price, 'v1.0' as model_version from ranked)"""

REGIONAL_VARIATION_MART = f"""{REGION_IDS},
regional_variation as ({lr.by_sql(['region', 'city'])}),
regional_variation_mart as (
  select feature_id, region_id, {dec('importance_score', 5, 2)} as importance_score, {r('relative_importance', 6)} as relative_importance
  from regional_variation join region_ids on region_name = region || '/' || city join feature_mart using (feature_name))"""

TEMPORAL_VARIATION_MART = f"""
temporal_variation as ({lr.by_sql(['cast(year(transaction_date) as int)', 'cast(quarter(transaction_date) as int)'])}),
temporal_variation_mart as (
  select feature_id, period_year, period_quarter, {dec('importance_score', 5, 2)} as importance_score
  from temporal_variation as t(feature_name, period_year, period_quarter, importance_score, relative_importance)
  join feature_mart using (feature_name))"""

REGIONAL_CTES = f"{LISTINGS}, {REGIONAL_MART}"
NEIGHBORHOOD_CTES = f"{LISTINGS}, {REGION_IDS}, {NEIGHBORHOOD_MART}"
SEASONAL_CTES = f"{LISTINGS}, {REGION_IDS}, {SEASONAL_MART}"
FEATURE_CTES = f"{lr.RANKED}, {FEATURE_MART}"
REGIONAL_VARIATION_CTES = f"{FEATURE_CTES}, {REGIONAL_VARIATION_MART}"
TEMPORAL_VARIATION_CTES = f"{FEATURE_CTES}, {TEMPORAL_VARIATION_MART}"


@family.add("mart_regional_trends", f"with {REGIONAL_CTES} select * from regional_mart")
def mart_regional_trends(spark, folder):
    return regional_mart(spark, folder).drop(*STAMPS)


@family.add("mart_neighborhoods", f"with {NEIGHBORHOOD_CTES} select * from neighborhood_mart")
def mart_neighborhoods(spark, folder):
    return neighborhood_mart(spark, folder).drop(*STAMPS)


@family.add("mart_seasonal", f"with {SEASONAL_CTES} select * from seasonal_mart")
def mart_seasonal(spark, folder):
    return seasonal_mart(spark, folder).drop(*STAMPS)


@family.add("mart_feature_importance", f"with {FEATURE_CTES} select * from feature_mart")
def mart_feature_importance(spark, folder):
    return feature_mart(spark, folder).drop(*STAMPS)


@family.add("mart_regional_variation", f"with {REGIONAL_VARIATION_CTES} select * from regional_variation_mart")
def mart_regional_variation(spark, folder):
    return regional_variation_mart(spark, folder).drop(*STAMPS).withColumn(
        "relative_importance", F.round(F.col("relative_importance").cast("decimal(30,8)"), 6).cast("double"))


@family.add("mart_temporal_variation", f"with {TEMPORAL_VARIATION_CTES} select * from temporal_variation_mart")
def mart_temporal_variation(spark, folder):
    return temporal_variation_mart(spark, folder).drop(*STAMPS)


def key_sql(contract: contracts.Contract, source: str) -> str:
    """The rules of a contract's own columns, counted in SQL."""
    uniques = [contract.primary_key, *contract.unique]
    rules = [(f"unique({','.join(u)})", f"(select 1 from {source} group by {', '.join(u)} having count(*) > 1)") for u in uniques]
    rules += [(f"not_null({f.name})", f"{source} where {f.name} is null") for f in contract.schema.fields if not f.nullable]
    return " union all ".join(
        f"select '{contract.name}' as table_name, '{rule}' as rule, (select count(*) from {counted}) as violations" for rule, counted in rules)


def _keys_of(name: str, contract: contracts.Contract, ctes: str, build) -> None:
    @family.add(f"mart_keys_{name}", f"with {ctes} {key_sql(contract, f'{name}_mart')}")
    def query(spark, folder):
        return contracts.violations({contract.name: build(spark, folder)})


_keys_of("regional", contracts.REGIONAL_TRENDS, REGIONAL_CTES, regional_mart)
_keys_of("neighborhood", contracts.NEIGHBORHOODS, NEIGHBORHOOD_CTES, neighborhood_mart)
_keys_of("seasonal", contracts.SEASONAL, SEASONAL_CTES, seasonal_mart)
_keys_of("temporal_variation", contracts.TEMPORAL_VARIATION, TEMPORAL_VARIATION_CTES, temporal_variation_mart)


@family.add("mart_key_violations", f"""
with {FEATURE_CTES}, {REGIONAL_VARIATION_MART}
select 'dm_feature_importance' as table_name, 'unique(feature_id)' as rule,
  (select count(*) from (select 1 from feature_mart group by feature_id having count(*) > 1)) as violations
union all select 'dm_feature_importance', 'unique(feature_name)',
  (select count(*) from (select 1 from feature_mart group by feature_name having count(*) > 1))
union all select 'dm_feature_importance', 'not_null(feature_id)', (select count(*) from feature_mart where feature_id is null)
union all select 'dm_feature_importance', 'not_null(feature_name)', (select count(*) from feature_mart where feature_name is null)
union all select 'dm_feature_importance', 'not_null(feature_category)', (select count(*) from feature_mart where feature_category is null)
union all select 'dm_feature_importance', 'not_null(model_version)', (select count(*) from feature_mart where model_version is null)
union all select 'dm_regional_feature_variation', 'unique(feature_id,region_id)',
  (select count(*) from (select 1 from regional_variation_mart group by feature_id, region_id having count(*) > 1))
union all select 'dm_regional_feature_variation', 'not_null(feature_id)',
  (select count(*) from regional_variation_mart where feature_id is null)
union all select 'dm_regional_feature_variation', 'not_null(region_id)',
  (select count(*) from regional_variation_mart where region_id is null)
union all select 'dm_regional_feature_variation', 'foreign_key(feature_id)',
  (select count(*) from regional_variation_mart where feature_id not in (select feature_id from feature_mart))""")
def mart_key_violations(spark, folder):
    return contracts.violations({
        "dm_feature_importance": feature_mart(spark, folder),
        "dm_regional_feature_variation": regional_variation_mart(spark, folder)})


@family.add("io_warehouse_view_sales", f"""
with {LISTINGS} select region, city, sale_year, count(*) as sales, cast(sum(cast(price as decimal(18,2))) as double) as turnover
from listings group by region, city, sale_year""")
def io_warehouse_view_sales(spark, folder):
    """SQL text over the published warehouse view of sales."""
    warehouse.publish_views(source(spark, folder))
    return spark.sql("""
        SELECT region, city, sale_year, count(*) AS sales, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS turnover
        FROM dw_property_sales GROUP BY region, city, sale_year""")


@family.add("io_warehouse_view_time", f"""
with {LISTINGS} select sale_year, sale_quarter, count(*) as sales, min(price) as min_price, max(price) as max_price
from listings group by sale_year, sale_quarter""")
def io_warehouse_view_time(spark, folder):
    warehouse.publish_views(source(spark, folder))
    return spark.sql("""
        SELECT sale_year, sale_quarter, sum(properties_sold) AS sales, min(min_price) AS min_price, max(max_price) AS max_price
        FROM dw_time_metrics GROUP BY sale_year, sale_quarter""")


@family.add("io_warehouse_view_features", f"""
with {LISTINGS} select pool, roof_type, count(*) as properties, {r('avg(total_rooms)', 4)} as mean_rooms, max(bedrooms) as most_bedrooms
from listings group by pool, roof_type""")
def io_warehouse_view_features(spark, folder):
    """SQL text over the published warehouse view of features."""
    warehouse.publish_views(listings_view(spark, folder))
    return rounded(spark.sql("""
        select pool, roof_type, count(*) as properties, avg(total_rooms) as mean_rooms, max(bedrooms) as most_bedrooms
        from dw_property_features group by pool, roof_type"""), {"mean_rooms": 4})


@family.add("io_warehouse_view_locations", f"""
with {LISTINGS}, places as (
  select region, city, neighborhood, count(*) as properties_sold, {exact_mean('price')} as avg_price, min(price) as min_price, max(price) as max_price
  from listings group by region, city, neighborhood)
select region, city, neighborhood, properties_sold, avg_price, max_price - min_price as price_span from places where properties_sold >= 20""")
def io_warehouse_view_locations(spark, folder):
    """SQL text over the published warehouse view of locations."""
    warehouse.publish_views(source(spark, folder))
    return spark.sql("""
        select region, city, neighborhood, properties_sold, avg_price, max_price - min_price as price_span
        from dw_location_metrics where properties_sold >= 20""")
