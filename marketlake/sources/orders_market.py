"""Order tables seen as a property market: each order is a sale, its lines are the building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.functions.numbers import ratio
from marketlake.operators.history import with_previous
from marketlake.roles import Roles

ROLES = Roles()
UNIT_ROLES = Roles(unit_price="unit_price")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _places(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation, region = (table(spark, folder, n) for n in ("customer", "nation", "region"))
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.col("r_name").alias("region"), F.col("n_name").alias("city"),
                F.concat_ws("-", "n_name", "c_mktsegment").alias("neighborhood")))


def sales_view(spark: SparkSession, folder: str, listing: bool = False) -> DataFrame:
    """One row per order. ``listing`` adds the date of the same customer's order before it."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("property_id"), F.col("o_custkey"), F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.col("o_orderpriority").alias("property_type"), F.col("o_orderstatus").alias("condition"))
    if listing:
        orders = with_previous(
            orders, "o_custkey", F.col("transaction_date"), ["transaction_date", "property_id"],
            {"listing_date": "transaction_date"})
    return orders.join(_places(spark, folder), F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")


def building_view(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with lines: the lines counted and summed as rooms of a building."""
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    lines = table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("l_orderkey").alias("property_id")).agg(
        F.sum("l_quantity").alias("total_rooms"), F.count(F.lit(1)).alias("bedrooms"),
        F.count_distinct("l_suppkey").alias("bathrooms"), F.bool_or(F.col("l_returnflag") == "R").alias("pool"),
        F.min("p_type").alias("roof_type"))


def listings_view(spark: SparkSession, folder: str, listing: bool = False) -> DataFrame:
    """Sales joined with their buildings, with the price per room."""
    joined = sales_view(spark, folder, listing).join(building_view(spark, folder), "property_id")
    return joined.withColumn("unit_price", ratio(F.col("price"), F.col("total_rooms")))


def housing_view(spark: SparkSession, folder: str) -> DataFrame:
    """Orders, their customers and lines recoded into the columns of the housing shape, so that the housing
    rules run on them unchanged. Street, LotConfig and LandContour are left out on purpose."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("int").alias("lines"), F.sum("l_quantity").alias("quantity"),
        F.min("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"),
        F.year(F.min("l_shipdate")).alias("built"))
    orders = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    styles = F.array(*[F.lit(s) for s in ("1Story", "1.5Fin", "2Story", "2.5Unf", "SFoyer", "SLvl", "Other")])

    def recode(column, mapping):
        return F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), column)

    return joined.select(
        F.col("o_orderkey").alias("Id"), rank.alias("MSSubClass"), F.col("o_orderstatus").alias("MSZoning"),
        recode(F.col("c_mktsegment"), {"AUTOMOBILE": "NoRidge", "BUILDING": "Timber", "FURNITURE": "OldTown",
                                       "HOUSEHOLD": "Gilbert"}).alias("Neighborhood"),
        recode(rank, {1: "Ex", 2: "Gd", 3: "TA", 4: "Xx"}).alias("HeatingQC"),
        F.col("lines").alias("OverallQual"), recode(F.col("o_orderstatus"), {"F": 5, "O": 7}).alias("OverallCond"),
        (F.col("quantity") * 50).alias("LotArea"), F.year("o_orderdate").alias("YrSold"),
        F.month("o_orderdate").alias("MoSold"), F.col("built").alias("YearBuilt"), F.col("lines").alias("BedroomAbvGr"),
        F.col("lines").alias("FullBath"), recode(F.col("flag"), {"R": 1, "N": 0}).alias("HalfBath"),
        F.lit(1).alias("KitchenAbvGr"), F.get(styles, (F.col("c_nationkey") % 7)).alias("HouseStyle"),
        recode(F.col("flag"), {"A": "NA", "N": "", "R": "Attchd"}).alias("GarageType"),
        F.when(F.col("status") == "F", F.col("quantity")).when(F.col("status") == "O", 0.0).alias("PoolArea"),
        F.when(F.col("flag") == "N", F.col("quantity")).otherwise(0.0).alias("WoodDeckSF"),
        F.when(F.col("status") == "F", F.col("quantity")).alias("OpenPorchSF"), F.col("status").alias("Exterior1st"),
        F.col("flag").alias("RoofStyle"), F.col("c_mktsegment").alias("Heating"),
        recode(F.col("o_orderstatus"), {"F": "Y", "O": "N", "P": "X"}).alias("CentralAir"),
        recode(rank, {1: "WD", 2: "New", 3: "COD", 4: "ConLD", 5: "Cash"}).alias("SaleType"),
        recode(F.col("o_orderstatus"), {"F": "Family", "O": "Abnorml", "P": "Normal"}).alias("SaleCondition"))


def neighborhood_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Three numeric scores per neighborhood from the order lines, in place of the surveyed scores."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"),
        F.sum(F.col("l_discount").cast("decimal(18,2)")).alias("discount"),
        F.sum(F.col("l_tax").cast("decimal(18,2)")).alias("tax"))
    placed = sales_view(spark, folder).select("property_id", "neighborhood").join(
        lines, F.col("property_id") == F.col("l_orderkey"))
    sums = placed.groupBy("neighborhood").agg(*[F.sum(c).alias(c) for c in ("lines", "quantity", "discount", "tax")])
    return sums.select(
        "neighborhood", (ratio(F.col("quantity"), F.col("lines")) / 5).alias("walkability_score"),
        (ratio(F.col("discount"), F.col("lines")) * 100).alias("school_rating"),
        (ratio(F.col("tax"), F.col("lines")) * 100).alias("crime_index"))
