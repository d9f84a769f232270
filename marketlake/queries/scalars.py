"""One query per family of scalar functions in use."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.functions import dates, ids, jsontext, numbers, text
from marketlake.queries.base import Family, r
from marketlake.queries.trends import SEASONAL_NAMES
from marketlake.sources.orders_market import table

family = Family()


@family.add("scalar_string", """
select p_partkey, 'Part ' || p_partkey || ', ' || p_name as label, lower(p_type) as lower_type,
  ascii(substr(p_name, 2, 1)) as second_code, split_part(p_name, ' ', 2) as second_word,
  case when p_type like '%ECON%' then 'first' when p_type like '%A%' then 'second' else 'none' end as ladder,
  case when p_brand in ('Brand#1', 'Brand#2') then 'low' when p_brand in ('Brand#24', 'Brand#25') then 'high' else 'mid' end as member,
  replace(p_name, ' ', '_') as underscored, p_type in ('SMALL', 'LARGE') as is_listed from part""")
def scalar_string(spark, folder):
    name = F.col("p_name")
    return table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit("Part "), F.col("p_partkey").cast("string"), F.lit(", "), name).alias("label"),
        F.lower("p_type").alias("lower_type"), F.ascii(F.substring(name, 2, 1)).alias("second_code"),
        F.get(F.split(name, " "), F.lit(1)).alias("second_word"),
        text.like_ladder(F.col("p_type"), [("%ECON%", "first"), ("%A%", "second")], "none").alias("ladder"),
        text.membership_label(F.col("p_brand"), {"low": ("Brand#1", "Brand#2"), "high": ("Brand#24", "Brand#25")}, "mid").alias("member"),
        F.regexp_replace(name, " ", "_").alias("underscored"), F.col("p_type").isin("SMALL", "LARGE").alias("is_listed"))


@family.add("scalar_date", f"""
with d as (select o_orderkey, cast(o_orderdate as date) as day, cast(month(o_orderdate) as int) as sale_month,
                  cast(year(o_orderdate) as int) as y from orders)
select o_orderkey, day, y as year, sale_month as month, cast(quarter(day) as int) as quarter, 'Q' || quarter(day) as quarter_label,
  y || '-Q' || quarter(day) as period, y as parsed_year, cast(quarter(day) as int) as parsed_quarter,
  make_date(y, sale_month, 15) as mid_month, make_date(y, sale_month, 1) as first_day,
  cast(day - interval 1 month as date) as month_before, cast(date_diff('day', date '1995-01-01', day) as int) as days,
  strftime(day, '%b %Y') as month_label, {SEASONAL_NAMES},
  day between date '1996-01-01' and date '1996-12-31' as in_1996
from d""")
def scalar_date(spark, folder):
    day, month = F.col("day"), F.month("day")
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    period = dates.year_quarter_label(F.year("day"), F.quarter("day"))
    parsed_year, parsed_quarter = dates.parse_year_quarter(period)
    return rows.select(
        "o_orderkey", "day", F.year("day").alias("year"), month.alias("month"), F.quarter("day").alias("quarter"),
        dates.quarter_label(day).alias("quarter_label"), period.alias("period"), parsed_year.alias("parsed_year"),
        parsed_quarter.alias("parsed_quarter"), dates.mid_month(F.year("day"), month).alias("mid_month"),
        dates.first_of_month(F.year("day"), month).alias("first_day"), dates.one_month_before(day).alias("month_before"),
        dates.days_between_or(day, F.lit("1995-01-01").cast("date")).alias("days"),
        dates.month_label(day).alias("month_label"), dates.month_name(month).alias("month_name"),
        dates.season(month).alias("season"), day.between("1996-01-01", "1996-12-31").alias("in_1996"))


@family.add("scalar_math", f"""
select p_partkey, {r('p_retailprice / p_size', 2)} as per_size, abs(p_size - 25) as distance,
  {r('sqrt(power(p_size, 2) + power(p_retailprice, 2))', 6)} as length, cast(ceil(p_size / 3.0) as bigint) as thirds,
  p_size % 10 as last_digit, case when p_size > 25 then p_retailprice / p_size else p_retailprice end as guarded,
  p_retailprice / nullif(p_size - 7, 0) as divided,
  case when p_size - 10 > 0 then {r('(p_size - (p_size - 10)) * 100.0 / (p_size - 10)', 2)} end as change from part""")
def scalar_math(spark, folder):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, folder, "part").select(
        "p_partkey", numbers.steady_round(numbers.ratio(price, size), 2).alias("per_size"), F.abs(size - 25).alias("distance"),
        numbers.steady_round(F.sqrt(F.pow(size, 2) + F.pow(price, 2)), 6).alias("length"),
        F.ceil(size / F.lit(3.0)).alias("thirds"), (size % 10).alias("last_digit"),
        numbers.ratio_or_numerator(price, F.when(size > 25, size)).alias("guarded"),
        numbers.ratio(price, size - 7).alias("divided"), numbers.pct_change(size, size - 10).alias("change"))


@family.add("scalar_conditional", """
select o_orderkey, case o_orderstatus when 'F' then 'closed' when 'O' then 'open' else 'other' end as state,
  coalesce(nullif(o_orderstatus, 'P'), 'none') as status, nullif(o_orderstatus, 'P') is null as is_missing,
  case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 then 'mid' end as band from orders""")
def scalar_conditional(spark, folder):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        "o_orderkey", text.value_map(status, {"F": "closed", "O": "open"}, "other").alias("state"),
        F.coalesce(F.nullif(status, F.lit("P")), F.lit("none")).alias("status"),
        F.isnull(F.nullif(status, F.lit("P"))).alias("is_missing"),
        F.when(price > 300000, "high").when(price > 100000, "mid").alias("band"))


@family.add("scalar_json", """
select event_id, cast(json_extract_string(props, '$.k') as double) as k, coalesce(try_cast(json_extract_string(props, '$.z') as double), 0.8) as z,
  cast(json_extract_string(props, '$.k') as double) as from_map, 'k' as key from events""")
def scalar_json(spark, folder):
    events = table(spark, folder, "events").select("event_id", "props", jsontext.number_map(F.col("props")).alias("m"))
    back = events.withColumn("again", jsontext.to_json_text(F.col("m")))
    return back.select(
        "event_id", jsontext.json_number(F.col("again"), "k").alias("k"), jsontext.json_number(F.col("props"), "z", 0.8).alias("z"),
        F.explode("m").alias("key", "from_map"))


@family.add("scalar_cast", """
select o_orderkey, cast(o_orderkey as varchar) as text, cast(trunc(o_totalprice) as int) as whole,
  cast(o_totalprice as decimal(12,2)) as money, try_cast(o_orderpriority as double) as number,
  cast(o_orderdate as date) as day, o_orderstatus = 'F' as flag from orders""")
def scalar_cast(spark, folder):
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("text"), price.cast("int").alias("whole"),
        price.cast("decimal(12,2)").alias("money"), F.col("o_orderpriority").try_cast("double").alias("number"),
        F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderstatus") == "F").cast("boolean").alias("flag"))


@family.add("scalar_hash")
def scalar_hash(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", F.hash("o_orderpriority").alias("hash"), ids.wide_hash_id(F.col("o_orderkey")).alias("wide"),
        ids.hash_bucket(F.col("o_orderkey"), 3).alias("part"), F.monotonically_increasing_id().alias("row_id"))
