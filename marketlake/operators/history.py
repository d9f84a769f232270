"""Earlier values of the same key, series ends, trend lines and row numbers, without one task per key."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.operators.grouped import null_safe_match
from marketlake.sources.files import scratch_table


def with_previous(
    df: DataFrame, key: str, chunk: Column, order: list[str], values: dict[str, str]
) -> DataFrame:
    """Add the value of the row before, per ``key`` in the total order ``order``.

    ``values`` maps a new column to the column it is read from. ``chunk`` is a coarse, order-preserving
    part of the order (for instance the day): the window runs per (key, chunk), so one hot key spreads over
    its chunks. Only the last row of each chunk, found by a map-side-combined aggregate, crosses chunks.
    """
    rows = df.withColumn("__chunk", chunk)
    position = F.struct(*[F.col(c) for c in order])
    payload = F.struct(*[F.col(source).alias(name) for name, source in values.items()])
    last = rows.groupBy(key, "__chunk").agg(F.max_by(payload, position).alias("__last"))
    carried = last.select(
        F.col(key).alias("__key"),
        F.col("__chunk").alias("__in"),
        F.lag("__last").over(Window.partitionBy(key).orderBy("__chunk")).alias("__carried"))
    inside = rows.withColumn(
        "__before", F.lag(payload).over(Window.partitionBy(key, "__chunk").orderBy(*order)))
    joined = inside.join(carried, null_safe_match(inside, carried, [(key, "__key"), ("__chunk", "__in")]), "left")
    before = F.coalesce(F.col("__before"), F.col("__carried"))
    return joined.select(*df.columns, *[before[name].alias(name) for name in values])


def in_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of ``order`` (nulls first), as a written table with the number of each row's range in ``__range``.

    Rows of one key spread over as many ranges as they fill, unless they agree in all columns of the order. The table is written because
    range edges are sampled: every later step must see the same ones.
    """
    ranges = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return scratch_table(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def previous_by_range(df: DataFrame, key: str, order: list[str], values: dict[str, str], ranges: int | None = None) -> DataFrame:
    """As ``with_previous``, for keys that may be hot even within a chunk: no task holds more than a range of (key, order).

    The row before stands in the same range, or is the last row of the range before: one row a range is carried over. Rows of one
    key that agree in the whole order follow each other in no stated order.
    """
    rows = in_ranges(df, [key, *order], ranges)
    payload = F.struct(F.col(key).alias("k"), *[F.col(source).alias(name) for name, source in values.items()])
    last = rows.groupBy("__range").agg(F.max_by(payload, F.struct(key, *order)).alias("__last"))
    carried = last.select("__range", F.lag("__last").over(Window.orderBy("__range")).alias("__carried"))  # one row a range
    inside = rows.withColumn("__before", F.lag(payload).over(Window.partitionBy("__range").orderBy(key, *order)))
    joined = inside.join(carried, "__range", "left")
    before = F.coalesce(F.col("__before"), F.col("__carried"))
    same = before.isNotNull() & before["k"].eqNullSafe(F.col(key))
    return joined.select(*df.columns, *[F.when(same, before[name]).alias(name) for name in values])


def series_change(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """First value, last value and total percent variation of each series."""
    return (
        df.groupBy(*keys)
        .agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))
        .withColumn("variation_pct",
                    F.try_divide(F.col("last_value") - F.col("first_value"), F.col("first_value")) * F.lit(100.0)))


def trend_line(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Least-squares line of ``value`` on the 0-based position in each series, with the fitted value.

    Meant for aggregated series (one row per period and key).
    """
    position = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    indexed = df.withColumn("position", F.row_number().over(position) - 1)
    x, y = F.col("position").cast("double"), F.col(value).cast("double")
    slope = F.coalesce(F.try_divide(F.covar_pop(x, y).over(whole), F.var_pop(x).over(whole)), F.lit(0.0))
    return (
        indexed.withColumn("slope", slope)
        .withColumn("intercept", F.avg(y).over(whole) - F.col("slope") * F.avg(x).over(whole))
        .withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("position")))


def number_rows(df: DataFrame, order: str, name: str, start: int = 1, parts: int | None = None) -> DataFrame:
    """Consecutive numbers in the order of a unique numeric column, computed in ``parts`` ranges (as many as a shuffle has).

    A window without partitions would sort the table in one task. Range edges come from one approximate
    quantile job; each range numbers its rows and adds the number of rows in the ranges before it.
    """
    parts = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], min(0.001, 0.1 / parts))))
    if edges:
        cut = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="__order", outputCol="__part")
        ranged = cut.transform(df.withColumn("__order", F.col(order).cast("double"))).drop("__order")
    else:
        ranged = df.withColumn("__part", F.lit(0.0))
    sizes = ranged.groupBy("__part").count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    numbered = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    return (
        numbered.join(F.broadcast(offsets), "__part")  # at most ``parts`` rows
        .select(*df.columns, (F.col("__n") + F.col("__offset") + F.lit(start - 1)).cast("bigint").alias(name)))


def large_dictionary(df: DataFrame, column: str, id_name: str, ranges: int | None = None) -> DataFrame:
    """As ``dictionary``, for any number of names: each range numbers its own and adds how many stand before it."""
    names = in_ranges(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], ranges)
    sizes = names.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    number = F.row_number().over(Window.partitionBy("__range").orderBy(column))
    return names.withColumn("__n", number).join(offsets, "__range").select(column, (F.col("__n") + F.col("__offset")).cast("bigint").alias(id_name))


def dictionary(df: DataFrame, column: str, id_name: str) -> DataFrame:
    """Distinct names with ids 1, 2, … in name order, for dimension-sized columns."""
    names = df.select(column).where(F.col(column).isNotNull()).distinct()
    return names.withColumn(id_name, F.row_number().over(Window.orderBy(column)).cast("int"))
