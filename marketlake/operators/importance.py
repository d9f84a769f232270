"""How strongly features go with the price: correlations, category spread, ranks and variations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions.numbers import average, correlation, ratio


def _number(name: str):
    return F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0))


def correlations(df: DataFrame, features: list[str], target: str, by: list[str] = ()) -> DataFrame:
    """Correlation of every numeric feature with the target, nulls as 0, in one aggregate; long rows."""
    y = _number(target)
    wide = df.groupBy(*by).agg(*[correlation(_number(f), y).alias(f) for f in features])
    return wide.unpivot(list(by), features, "feature_name", "correlation_with_price")


def category_means(df: DataFrame, features: list[str], target: str, money_scale: int | None = None) -> DataFrame:
    """Mean target and row count of each value of each categorical feature, from one aggregate."""
    pairs = df.select(
        _number(target).alias("target"),
        F.inline(F.array(*[
            F.struct(F.lit(f).alias("feature_name"), F.col(f"`{f}`").cast("string").alias("category"))
            for f in features])))
    return pairs.groupBy("feature_name", "category").agg(
        average(F.col("target"), money_scale).alias("avg_price"), F.count(F.lit(1)).alias("property_count"))


def category_impact(means: DataFrame) -> DataFrame:
    """Variance of the category means per feature, and that variance relative to the largest one."""
    spread = means.groupBy("feature_name").agg(
        F.coalesce(F.var_samp("avg_price"), F.lit(0.0)).alias("price_variance"),
        F.count(F.lit(1)).alias("category_count"))
    largest = F.max("price_variance").over(Window.partitionBy())  # one row per feature
    return spread.withColumn(
        "impact", F.when(largest > 0, ratio(F.col("price_variance"), largest)).otherwise(F.lit(0.0)))


def feature_importance(
    df: DataFrame, numeric: list[str], categorical: list[str], target: str = "price", money_scale: int | None = None
) -> DataFrame:
    """Numeric correlations and categorical impacts in one ranked table."""
    numbers = correlations(df, numeric, target).select(
        "feature_name", "correlation_with_price", F.abs("correlation_with_price").alias("abs_correlation"),
        F.lit("numeric").alias("feature_type"))
    classes = category_impact(category_means(df, categorical, target, money_scale)).select(
        "feature_name", F.col("impact").alias("correlation_with_price"), F.col("impact").alias("abs_correlation"),
        F.lit("categorical").alias("feature_type"), "category_count")
    united = numbers.unionByName(classes, allowMissingColumns=True)
    strongest = Window.orderBy(F.col("abs_correlation").desc_nulls_last())  # one row per feature
    return united.withColumn("importance_rank", F.dense_rank().over(strongest))


def importance_by(df: DataFrame, by: list[str], numeric: list[str], target: str = "price") -> DataFrame:
    """Absolute correlation per feature and group, with its ratio to the feature's overall value."""
    grouped = correlations(df, numeric, target, by).withColumn("importance_score", F.abs("correlation_with_price"))
    overall = correlations(df, numeric, target).select(
        "feature_name", F.abs("correlation_with_price").alias("__overall"))
    return grouped.join(overall, "feature_name").select(
        "feature_name", *by, "importance_score",
        ratio(F.col("importance_score"), F.col("__overall")).alias("relative_importance"))
