"""Group summaries with exact medians that never hold a whole group in one task.

A median needs the order of a group's values. The built-in exact percentile keeps every distinct value
of a group in one buffer, which a group holding a third of all rows would overflow. Here one aggregation
computes the plain statistics and a fixed-size quantile sketch per group:

* for a group of at most ``exact_below`` values the sketch's rank error is below one rank, so it already
  names the two middle values;
* for a larger group the sketch brackets the middle. A second pass over the rows keeps only values inside
  the bracket (a fraction of a percent), counts equal values map-side, and finds the two middle ranks by a
  running count. Values below the bracket are only counted.

Both parts share the first aggregation's shuffle; results are exact for any group size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000


def _middle(low: Column, high: Column) -> Column:
    return low + (high - low) * F.lit(0.5).cast("double")


def null_safe_match(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def summarize(
    df: DataFrame,
    keys: list[str],
    aggregates: dict[str, Column],
    medians: dict[str, str],
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """``keys`` + ``aggregates`` (name → aggregate Column) + ``medians`` (name → value column)."""
    exact_below = accuracy // 4
    margin = 4.0 / accuracy
    probes = F.array(*[F.lit(p) for p in (0.5, 0.5 + 1e-9, 0.5 - margin, 0.5 + margin)])
    names = list(medians)
    columns = [a.alias(n) for n, a in aggregates.items()]
    for i, name in enumerate(names):
        value = F.col(medians[name]).cast("double")
        columns.append(F.count(value).alias(f"__n{i}"))
        columns.append(F.percentile_approx(value, probes, accuracy).alias(f"__q{i}"))
    first = df.groupBy(*keys).agg(*columns)

    is_large = reduce(lambda a, b: a | b, [F.col(f"__n{i}") > exact_below for i in range(len(names))])
    kept = [*keys, *aggregates]
    small = first.where(~is_large).select(
        *kept,
        *[_middle(F.col(f"__q{i}")[0], F.col(f"__q{i}")[1]).alias(n) for i, n in enumerate(names)])

    # Every column of the first aggregation travels with the bracket, so both uses read one shuffle.
    bracket = first.where(is_large).select(
        *[F.col(k).alias(f"__b_{k}") for k in keys],
        F.struct(*[c for c in first.columns if c not in keys]).alias("__s"))
    values = [F.col(medians[n]).cast("double") for n in names]
    metric = [] if len(names) == 1 else ["__m"]
    tagged = [values[0].alias("__x")] if not metric else [F.posexplode(F.array(*values)).alias("__m", "__x")]
    rows = df.select(*keys, *tagged).where(F.col("__x").isNotNull())
    joined = rows.join(bracket, null_safe_match(rows, bracket, [(k, f"__b_{k}") for k in keys]))

    def of_metric(prefix: str) -> Column:
        fields = [F.col(f"__s.{prefix}{i}") for i in range(len(names))]
        return F.get(F.array(*fields), F.col("__m")) if metric else fields[0]

    inside = (
        joined.where(F.col("__x") <= of_metric("__q")[3])
        .select(*keys, *metric, of_metric("__n").alias("__total"), F.when(F.col("__x") >= of_metric("__q")[2], F.col("__x")).alias("__v"))
        .groupBy(*keys, *metric, "__total", "__v").agg(F.count(F.lit(1)).alias("__c")))
    running = Window.partitionBy(*keys, *metric).orderBy(F.col("__v").asc_nulls_first())
    ranked = inside.withColumn(
        "__upto", F.sum("__c").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = F.col("__total")
    lower = F.when(F.col("__upto") >= F.floor((total + 1) / 2), F.struct("__v"))
    upper = F.when(F.col("__upto") >= F.floor(total / 2) + 1, F.struct("__v"))
    ends = []
    for i in range(len(names)):
        mine = (F.col("__m") == i) if metric else F.lit(True)
        ends += [F.min(F.when(mine, lower)).alias(f"__l{i}"), F.min(F.when(mine, upper)).alias(f"__h{i}")]

    def median(i: int) -> Column:
        """Missing for a group without values; a middle outside the bracket cannot happen and would raise."""
        low, high, size = F.col(f"__l{i}.__v"), F.col(f"__h{i}.__v"), F.col(f"__s.__n{i}")
        missed = F.raise_error(F.lit("median outside its bracket")).cast("double")
        return F.when(size == 0, F.lit(None).cast("double")).when(low.isNull() | high.isNull(), missed).otherwise(
            _middle(low, high))

    # Grouped by the keys alone: the floating-point aggregates may differ in their last bits if a lost task runs again.
    middles = ranked.groupBy(*keys).agg(*ends)
    large_result = middles.join(bracket, null_safe_match(middles, bracket, [(k, f"__b_{k}") for k in keys])).select(
        *keys, *[F.col(f"__s.{a}").alias(a) for a in aggregates], *[median(i).alias(n) for i, n in enumerate(names)])
    return small.unionByName(large_result)


def with_group_mean(df: DataFrame, keys: list[str], means: dict[str, Column]) -> DataFrame:
    """Each row next to its group's aggregates; rows with a null key drop out, as in an equi-join.

    Aggregating first keeps map-side combining, so a hot group costs no more than a cold one; a window
    over the detail rows would buffer the whole group in one task.
    """
    groups = df.groupBy(*keys).agg(*[a.alias(n) for n, a in means.items()])
    return df.join(groups, keys, "inner")
