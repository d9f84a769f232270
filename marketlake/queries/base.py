"""Registry helpers shared by the query families, and the SQL forms of the market views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.functions.numbers import steady_round

Query = Callable[[SparkSession, str], DataFrame]


class Family:
    """Collects ``name -> query`` and ``name -> SQL``."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query
        return register


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round columns whose last bits depend on the order of floating-point additions."""
    return df.select(*[
        (steady_round(F.col(f"`{c}`"), digits[c]).alias(c) if c in digits else F.col(f"`{c}`")) for c in df.columns])


def r(expression: str, digits: int) -> str:
    """The SQL form of ``steady_round``."""
    return f"cast(round(cast({expression} as decimal(30,8)), {digits}) as double)"


def r_all(digits: dict[str, int]) -> str:
    """Body of a REPLACE clause rounding the given columns."""
    return ", ".join(f"{r(c, d)} as {c}" for c, d in digits.items())


# One row per order; listing date = the customer's order before it.
SALES = """
sales as (
  select o_orderkey as property_id, o_totalprice as price, cast(o_orderdate as date) as transaction_date,
         o_orderpriority as property_type, o_orderstatus as condition, r_name as region, n_name as city,
         n_name || '-' || c_mktsegment as neighborhood,
         cast(lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as date) as listing_date,
         cast(year(o_orderdate) as int) as sale_year, cast(month(o_orderdate) as int) as sale_month,
         'Q' || cast(quarter(o_orderdate) as varchar) as sale_quarter
  from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""

BUILDINGS = """
buildings as (
  select l_orderkey as property_id, sum(l_quantity) as total_rooms, count(*) as bedrooms,
         count(distinct l_suppkey) as bathrooms, bool_or(l_returnflag = 'R') as pool, min(p_type) as roof_type
  from lineitem join part on l_partkey = p_partkey group by l_orderkey)"""

LISTINGS = SALES + "," + BUILDINGS + """,
listings as (
  select sales.*, total_rooms, bedrooms, bathrooms, pool, roof_type, price / total_rooms as unit_price
  from sales join buildings using (property_id))"""


def exact_mean(column: str, scale: int = 2) -> str:
    """Average as an exact decimal sum and one division."""
    return f"(cast(sum(cast({column} as decimal(18,{scale}))) as double) / count({column}))"


PRICE_STATS = f"""count(property_id) as properties_sold, {exact_mean('price')} as avg_price,
  stddev_samp(price) as price_stddev, min(price) as min_price, max(price) as max_price,
  quantile_cont(price, 0.5) as median_price"""


def grain_sql(period_type: str, keys: tuple[str, ...], extra: str = "", source: str = "sales") -> str:
    """One grain of the period statistics with null for the keys outside it."""
    text = ("region", "city", "neighborhood", "property_type")
    columns = [f"'{period_type}' as period_type"]
    columns += [k if k in keys else f"cast(null as varchar) as {k}" for k in text]
    columns += ["sale_year"]
    columns += ["sale_quarter" if "sale_quarter" in keys else "cast(null as varchar) as sale_quarter"]
    columns += ["sale_month" if "sale_month" in keys else "cast(null as int) as sale_month"]
    value = "cast(sale_month as varchar)" if "sale_month" in keys else "sale_quarter"
    return (f"select {', '.join(columns)}, {PRICE_STATS}{extra}, {value} as period_value "
            f"from {source} group by {', '.join(keys)}")


MONTHLY = grain_sql("monthly", ("region", "city", "sale_year", "sale_month"))
QUARTERLY = grain_sql("quarterly", ("region", "city", "sale_year", "sale_quarter"))
NEIGHBORHOOD = grain_sql("neighborhood_monthly", ("neighborhood", "sale_year", "sale_month"))
TYPE_QUARTERLY = grain_sql("property_type_quarterly", ("property_type", "region", "city", "sale_year", "sale_quarter"))

TRENDS = f"""
stats as ({MONTHLY} union all {QUARTERLY} union all {NEIGHBORHOOD} union all {TYPE_QUARTERLY}),
trends as (
  select *, cast(null as double) as moving_avg_3m from stats
  union all
  select * replace ('moving_avg_3m' as period_type),
         avg(avg_price) over (partition by region, city order by sale_year, sale_month rows 2 preceding)
  from stats where period_type = 'monthly')"""
