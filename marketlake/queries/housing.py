"""The row rules and the four dimension tables, on orders recoded to the housing shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.functions import rules
from marketlake.operators.history import previous_by_range, with_previous
from marketlake.plans import dimensions
from marketlake.queries.base import Family, r, rounded
from marketlake.sources.orders_market import housing_view, table

family = Family()

HOUSING = """
order_lines as (
  select l_orderkey, cast(count(*) as int) as n, sum(l_quantity) as q, min(l_returnflag) as rf, max(l_linestatus) as ls,
         cast(year(min(l_shipdate)) as int) as built from lineitem group by l_orderkey),
h as (
  select o_orderkey as Id, cast(left(o_orderpriority, 1) as int) as cls, o_orderstatus as st,
    case c_mktsegment when 'AUTOMOBILE' then 'NoRidge' when 'BUILDING' then 'Timber' when 'FURNITURE' then 'OldTown'
      when 'HOUSEHOLD' then 'Gilbert' end as nb,
    n, q, rf, ls, built, q * 50 as lot, cast(year(o_orderdate) as int) as yr, cast(month(o_orderdate) as int) as mo,
    case o_orderstatus when 'F' then 5 when 'O' then 7 end as cond, c_mktsegment as seg,
    case c_nationkey % 7 when 0 then '1Story' when 1 then '1.5Fin' when 2 then '2Story' when 3 then '2.5Unf'
      when 4 then 'SFoyer' when 5 then 'SLvl' else 'Other' end as style,
    case rf when 'R' then 1 when 'N' then 0 end as half,
    case rf when 'A' then 'NA' when 'N' then '' when 'R' then 'Attchd' end as garage_type,
    case ls when 'F' then q when 'O' then 0.0 end as pool_area,
    case when rf = 'N' then q else 0.0 end as deck, case when ls = 'F' then q end as porch,
    ['WD','New','COD','ConLD','Cash'][cast(left(o_orderpriority, 1) as int)] as sale_type,
    case o_orderstatus when 'F' then 'Family' when 'O' then 'Abnorml' when 'P' then 'Normal' end as sale_condition
  from orders join customer on o_custkey = c_custkey left join order_lines on o_orderkey = l_orderkey)"""

ENERGY = "case cls when 1 then 'A' when 2 then 'B' when 3 then 'C' else 'Non évalué' end"
SOLD = "make_date(yr, mo, 15)"
LISTED = "cast(make_date(yr, mo, 15) - interval 1 month as date)"
LON = "-93.62 + (ascii(substr(nb, 1, 1)) % 10) / 100.0"
LAT = "42.03 + (ascii(substr(nb, 2, 1)) % 10) / 100.0"
NEAR = ("case when nb in ('NoRidge', 'NridgHt', 'StoneBr') then 'Excellent' "
        "when nb in ('Somerst', 'Timber', 'Veenker', 'Crawfor') then 'Bon' "
        "when nb in ('BrkSide', 'OldTown', 'Edwards') then 'Limité' else 'Moyen' end")
ADDRESS = "'Propriété ' || Id || ', ' || nb"
ROOMS = "cast(coalesce(n, 0) + coalesce(n, 0) + coalesce(half, 0) + 1 as int)"
BATHS = "cast(coalesce(n, 0) + 0.5 * coalesce(half, 0) as double)"
FLOOR = "case style when '2Story' then 2 when '2.5Unf' then 2 else 1 end"
FLOORS = "case style when '1.5Fin' then 2 when '2Story' then 2 when '2.5Unf' then 3 when 'SLvl' then 2 else 1 end"
GARAGE = "coalesce(garage_type not in ('NA', ''), false)"
POOL = "coalesce(pool_area > 0, false)"
GARDEN = "coalesce(lot > 5000, false)"
TERRACE = "(coalesce(deck > 0, false) or coalesce(porch > 0, false))"
COOLING = "case st when 'F' then 'Central AC' when 'O' then 'None' end"
SELLER = "case sale_condition when 'Family' then 'Particulier' when 'Abnorml' then 'Bancaire' else 'Standard' end"
BUYER = ("case when sale_type like '%WD%' then 'Particulier' when sale_type like '%New%' then 'Premier acheteur' "
         "when sale_type like '%COD%' then 'Judiciaire' when sale_type like '%Con%' then 'Constructeur' else 'Autre' end")
FINANCING = "case when sale_type = 'Cash' then 'Comptant' else 'Conventionnel' end"
DAYS = "cast(100 - 8 * n + 5 * (10 - cond) as int)"
PRICE = "cast(n * lot * 10.0 as double)"
PER_AREA = r("n * lot * 10.0 / case when lot > 0 then lot end", 2)


@family.add("rules_value_map", f"with {HOUSING} select Id, {ENERGY} as energy_rating from h")
def rules_value_map(spark, folder):
    rows = housing_view(spark, folder)
    return rows.select("Id", rules.energy_rating(rows).alias("energy_rating"))


@family.add("rules_arithmetic", f"""
with {HOUSING} select Id, {PRICE} as price, {PER_AREA} as price_per_sqft, {ROOMS} as total_rooms, {BATHS} as bathrooms,
  {DAYS} as days_on_market from h""")
def rules_arithmetic(spark, folder):
    rows = housing_view(spark, folder)
    amount = rules.price(rows)
    return rows.select(
        "Id", amount.alias("price"), rules.price_per_area(amount, F.col("LotArea")).alias("price_per_sqft"),
        rules.total_rooms(rows).alias("total_rooms"), rules.bathrooms(rows).alias("bathrooms"),
        rules.days_on_market_of(rows).alias("days_on_market"))


@family.add("rules_dates", f"""
with {HOUSING} select Id, {SOLD} as transaction_date, {LISTED} as listing_date, yr - built as age_at_sale from h""")
def rules_dates(spark, folder):
    rows = housing_view(spark, folder)
    return rows.select(
        "Id", rules.transaction_date(rows).alias("transaction_date"), rules.listing_date(rows).alias("listing_date"),
        rules.age_at_sale(F.col("YrSold"), F.col("YearBuilt")).alias("age_at_sale"))


@family.add("rules_text", f"""
with {HOUSING} select Id, {ADDRESS} as address, 'Ames' as city, '50010' as postal_code, 'Iowa' as region,
  {r(LON, 6)} as longitude, {r(LAT, 6)} as latitude from h""")
def rules_text(spark, folder):
    located = dimensions.location_details(housing_view(spark, folder)).withColumnRenamed("property_id", "Id")
    columns = ("Id", "address", "city", "postal_code", "region", "longitude", "latitude")
    return rounded(located.select(*columns), {"longitude": 6, "latitude": 6})


@family.add("rules_labels", f"""
with {HOUSING} select Id, {NEAR} as services_proximity, {FLOOR} as floor_number, {FLOORS} as total_floors,
  {COOLING} as cooling_system, {SELLER} as seller_type, {BUYER} as buyer_type, {FINANCING} as financing_type from h""")
def rules_labels(spark, folder):
    rows = housing_view(spark, folder)
    return rows.select("Id", *[getattr(rules, n)(rows).alias(n) for n in (
        "services_proximity", "floor_number", "total_floors", "cooling_system", "seller_type", "buyer_type", "financing_type")])


@family.add("rules_flags", f"""
with {HOUSING} select Id, {GARAGE} as garage, {POOL} as pool, {GARDEN} as garden, {TERRACE} as terrace from h""")
def rules_flags(spark, folder):
    rows = housing_view(spark, folder)
    return rows.select("Id", *[getattr(rules, n)(rows).alias(n) for n in ("garage", "pool", "garden", "terrace")])


@family.add("rules_previous_price", f"""
with lagged as (select o_orderkey, o_custkey, o_totalprice as price,
    lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as p from orders)
select o_orderkey, o_custkey, price, {r('coalesce(p, price * 0.9)', 4)} as previous_price,
  coalesce(case when p > 0 then {r('(price - p) / p * 100', 2)} end, 10.0) as price_change_percentage from lagged""")
def rules_previous_price(spark, folder):
    """The earlier sale of the same customer where there is one, else the assumed share."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").alias("price"))
    sold = with_previous(orders, "o_custkey", F.col("o_orderdate").cast("date"), ["o_orderdate", "o_orderkey"],
                         {"known": "price"})
    priced = sold.select(
        "o_orderkey", "o_custkey", "price", rules.previous_price(F.col("price"), F.col("known")).alias("previous_price"),
        rules.price_change_percentage(F.col("price"), F.col("known")).alias("price_change_percentage"))
    return rounded(priced, {"previous_price": 4})


@family.add("rules_previous_price_hot_key", """
select o_orderkey, o_orderstatus, o_totalprice as price, lag(o_totalprice) over (partition by o_orderstatus order by o_orderdate, o_orderkey) as known
from orders""")
def rules_previous_price_hot_key(spark, folder):
    """The sale before of the same status: three keys hold all rows, so the order is dealt by ranges."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", F.col("o_totalprice").alias("price"))
    return previous_by_range(orders, "o_orderstatus", ["o_orderdate", "o_orderkey"], {"known": "price"}).drop("o_orderdate")


@family.add("rules_column_preference", f"with {HOUSING} select Id, rf as roof_type from h")
def rules_column_preference(spark, folder):
    rows = housing_view(spark, folder)
    return rows.select("Id", rules.roof_type(rows).alias("roof_type"))


NO_STAMPS = ("processing_timestamp", "source_system", "created_at")


@family.add("dims_property", f"""
with {HOUSING} select Id as property_id, cast(cls as varchar) as property_type, {PRICE} as price, lot as surface,
  cast(cond as varchar) as condition, {ENERGY} as energy_rating, {SOLD} as transaction_date, {LISTED} as listing_date,
  cast(null as double) as data_quality_score, yr - built as age_at_sale, {PER_AREA} as price_per_sqft from h""")
def dims_property(spark, folder):
    return dimensions.property_details(housing_view(spark, folder)).drop(*NO_STAMPS)


@family.add("dims_location", f"""
with {HOUSING} select Id as property_id, {ADDRESS} as address, 'Ames' as city, '50010' as postal_code, 'Iowa' as region,
  {r(LON, 6)} as longitude, {r(LAT, 6)} as latitude, nb as neighborhood, st as zoning_code, cast(null as varchar) as street_type,
  cast(null as varchar) as lot_config, cast(null as varchar) as land_contour, {NEAR} as services_proximity from h""")
def dims_location(spark, folder):
    located = dimensions.location_details(housing_view(spark, folder)).drop(*NO_STAMPS)
    return rounded(located, {"longitude": 6, "latitude": 6})


@family.add("dims_building", f"""
with {HOUSING} select Id as property_id, n as bedrooms, cast(null as int) as rooms, {BATHS} as bathrooms, {ROOMS} as total_rooms,
  {FLOOR} as floor_number, {FLOORS} as total_floors, {GARAGE} as garage, false as parking, {POOL} as pool, {GARDEN} as garden,
  {TERRACE} as terrace, ls as construction_material, rf as roof_type, seg as heating_system, {COOLING} as cooling_system from h""")
def dims_building(spark, folder):
    return dimensions.building_features(housing_view(spark, folder)).drop(*NO_STAMPS)


@family.add("dims_sale_history", f"""
with {HOUSING} select Id as property_id, {SOLD} as transaction_date, {PRICE} as sale_price, sale_type, sale_condition,
  {r('n * lot * 9.0', 4)} as previous_price, 10.0 as price_change_percentage, {DAYS} as days_on_market,
  {SELLER} as seller_type, {BUYER} as buyer_type, {FINANCING} as financing_type from h""")
def dims_sale_history(spark, folder):
    return rounded(dimensions.sale_history(housing_view(spark, folder)).drop(*NO_STAMPS), {"previous_price": 4})
