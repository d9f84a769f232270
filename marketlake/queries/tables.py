"""Joins, keyed merges, key checks and hash partitioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.functions.ids import hash_bucket
from marketlake.functions.numbers import average, ratio
from marketlake.operators import features, merging, periods
from marketlake.operators.grouped import with_group_mean
from marketlake.operators.market import market_indicators
from marketlake.plans import analytics, serving
from marketlake.queries import marts as m
from marketlake.queries.base import BUILDINGS, LISTINGS, NEIGHBORHOOD, SALES, Family, exact_mean, r, rounded
from marketlake.queries.housing import HOUSING, NEAR
from marketlake.plans import dimensions
from marketlake.queries.market import indicators_sql
from marketlake.sources.orders_market import building_view, housing_view, sales_view, table

family = Family()


@family.add("join_dims_inner", f"""
with {SALES}, {BUILDINGS} select sales.property_id, price, region, city, neighborhood, total_rooms, bedrooms, bathrooms, pool, roof_type
from sales join buildings using (property_id)""")
def join_dims_inner(spark, folder):
    return sales_view(spark, folder).join(building_view(spark, folder), "property_id").select(
        "property_id", "price", "region", "city", "neighborhood", "total_rooms", "bedrooms", "bathrooms", "pool", "roof_type")


@family.add("join_dims_three", f"""
with {HOUSING} select Id as property_id, n * lot * 10.0 as price, cast(n as int) as bedrooms, nb as neighborhood, st as zoning_code from h""")
def join_dims_three(spark, folder):
    """Property, building and location dimensions on the property id."""
    tables = dimensions.dimension_tables(housing_view(spark, folder))
    joined = analytics.importance_rows(
        tables["property_details"], tables["building_features"], tables["location_details"])
    return joined.select("property_id", "price", "bedrooms", "neighborhood", "zoning_code")


@family.add("join_trend_left", f"""
with {SALES}, late as ({NEIGHBORHOOD})
select property_id, s.neighborhood, s.sale_year as transaction_year, s.sale_month as transaction_month, s.price as target_price,
  v.avg_price as neighborhood_avg_price, case when v.avg_price > 0 then s.price / v.avg_price else 1.0 end as price_to_neighborhood_ratio
from sales s left join late v using (neighborhood, sale_year, sale_month)""")
def join_trend_left(spark, folder):
    sales = sales_view(spark, folder)
    trends = periods.period_stats(sales, grains=["neighborhood_monthly"])
    rows = sales.select(
        "property_id", "neighborhood", F.year("transaction_date").alias("transaction_year"),
        F.month("transaction_date").alias("transaction_month"), F.col("price").alias("target_price"))
    return features.with_neighborhood_trend(rows, trends).drop("neighborhood_median_price")


@family.add("join_labels_left", """
select doc_id, lang, quality, toxic, coalesce(quality, 0) as known_good from documents left join labels using (doc_id)""")
def join_labels_left(spark, folder):
    """Documents with their labels; most have none."""
    labels = table(spark, folder, "labels")
    return table(spark, folder, "documents").join(labels, "doc_id", "left").select(
        "doc_id", "lang", "quality", "toxic", F.coalesce("quality", F.lit(0)).alias("known_good"))


@family.add("join_group_average", f"""
with {SALES}, g as (select region, city, {exact_mean('price')} as city_avg_price from sales group by region, city)
select property_id, region, city, price, city_avg_price, price / city_avg_price as price_to_city_ratio
from sales join g using (region, city)""")
def join_group_average(spark, folder):
    sales = sales_view(spark, folder).select("property_id", "region", "city", "price")
    joined = with_group_mean(sales, ["region", "city"], {"city_avg_price": average(F.col("price"), 2)})
    return joined.withColumn("price_to_city_ratio", ratio(F.col("price"), F.col("city_avg_price")))


@family.add("join_marts_left", f"""
with {SALES}, {indicators_sql(False)}, p as (select neighborhood, {exact_mean('price')} as avg_price from sales group by neighborhood),
d as (select neighborhood, avg(avg_days_on_market) as days from indicators group by neighborhood)
select neighborhood, avg_price, {r('coalesce(days, 30)', 4)} as avg_days_on_market from p left join d using (neighborhood)""")
def join_marts_left(spark, folder):
    sales = sales_view(spark, folder, listing=True)
    prices = sales.groupBy("neighborhood").agg(average(F.col("price"), 2).alias("avg_price"))
    days = market_indicators(sales).groupBy("neighborhood").agg(F.avg("avg_days_on_market").alias("days"))
    joined = prices.join(days, "neighborhood", "left").select(
        "neighborhood", "avg_price", F.coalesce("days", F.lit(30.0)).alias("avg_days_on_market"))
    return rounded(joined, {"avg_days_on_market": 4})


@family.add("join_region_semi", f"""
with {SALES} select property_id, region, city, price from sales
where city in (select n_name from nation join supplier on n_nationkey = s_nationkey)""")
def join_region_semi(spark, folder):
    served = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("city"))
    return sales_view(spark, folder).join(served, "city", "left_semi").select("property_id", "region", "city", "price")


@family.add("join_dim_lookup", f"""
with {m.TEMPORAL_VARIATION_CTES} select feature_id, feature_name, feature_category, period_year, period_quarter, importance_score
from temporal_variation_mart join feature_mart using (feature_id)""")
def join_dim_lookup(spark, folder):
    names = m.feature_mart(spark, folder).select("feature_id", "feature_name", "feature_category")
    return m.temporal_variation_mart(spark, folder).drop("created_at").join(names, "feature_id")


@family.add("io_upsert_merge", """
with batch as (select l_orderkey as o_orderkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as o_totalprice
               from lineitem where l_returnflag = 'R' group by l_orderkey)
select o_orderkey, o_totalprice from orders where o_orderkey not in (select o_orderkey from batch)
union all select o_orderkey, o_totalprice from batch""")
def io_upsert_merge(spark, folder):
    """Order totals replaced by the sum of their returned lines; keys new to the target are added."""
    batch = table(spark, folder, "lineitem").where("l_returnflag = 'R'").groupBy(
        F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("o_totalprice"))
    target = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return merging.upsert(target, batch, ["o_orderkey"])


@family.add("io_key_violations", """
select 'lineitem' as table_name, 'unique(l_orderkey,l_linenumber)' as rule,
  (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)) as violations
union all select 'lineitem', 'not_null(l_orderkey)', (select count(*) from lineitem where l_orderkey is null)
union all select 'lineitem', 'not_null(l_shipdate)', (select count(*) from lineitem where l_shipdate is null)
union all select 'lineitem', 'foreign_key(l_orderkey)',
  (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders))
union all select 'documents', 'unique(doc_id)', (select count(*) from (select 1 from documents group by doc_id having count(*) > 1))
union all select 'documents', 'not_null(text)', (select count(*) from documents where text is null)
union all select 'documents', 'foreign_key(doc_id)', (select count(*) from documents where doc_id not in (select doc_id from labels))""")
def io_key_violations(spark, folder):
    lines = table(spark, folder, "lineitem")
    found = merging.key_violations(
        lines, "lineitem", [["l_orderkey", "l_linenumber"]], ["l_orderkey", "l_shipdate"],
        [("l_orderkey", table(spark, folder, "orders"), "o_orderkey")])
    # Many documents have no label: a reference with violations.
    return found.unionByName(merging.key_violations(
        table(spark, folder, "documents"), "documents", [["doc_id"]], ["text"],
        [("doc_id", table(spark, folder, "labels"), "doc_id")]))


@family.add("io_hash_partition")
def io_hash_partition(spark, folder):
    """Rows per hash bucket of the order key."""
    bucket = hash_bucket(F.col("o_orderkey"), 3)
    return table(spark, folder, "orders").groupBy(bucket.alias("part")).agg(F.count(F.lit(1)).alias("rows"))


@family.add("io_hash_partition_of_copies", """
select count(*) as keys, 1 as most_parts_of_a_key, 0 as outside, sum(n)::bigint as rows from (
  select l_orderkey, count(*) as n from lineitem group by l_orderkey)""")
def io_hash_partition_of_copies(spark, folder):
    """All lines of an order fall in one bucket, and every bucket number is in range."""
    parts = table(spark, folder, "lineitem").select("l_orderkey", hash_bucket(F.col("l_orderkey"), 3).alias("part"))
    by_key = parts.groupBy("l_orderkey").agg(
        F.count_distinct("part").alias("parts"), F.count_if(~F.col("part").between(0, 2)).alias("outside"), F.count(F.lit(1)).alias("n"))
    return by_key.agg(F.count(F.lit(1)).alias("keys"), F.max("parts").alias("most_parts_of_a_key"), F.sum("outside").alias("outside"), F.sum("n").alias("rows"))
