"""Column statistics, outlier flags, completeness scores and column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.nulls import is_filled, numeric_columns
from marketlake.functions.numbers import ratio
from marketlake.operators.grouped import with_group_mean

STATS = ("mean", "stddev", "min", "max")
ANOMALY_PENALTY = 0.7  # fixed value
CATEGORY_LIMIT = 30  # fixed value


def _stats_struct(column: str) -> Column:
    c = F.col(f"`{column}`").cast("double")
    return F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("stddev"), F.min(c).alias("min"), F.max(c).alias("max"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """mean, sample deviation, min and max of every column from one pass: one row per column."""
    wide = df.agg(*[_stats_struct(c).alias(c) for c in columns])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}`")[s].alias(s) for s in STATS]) for c in columns])))


def stored_stats(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, deviation) per column as plain numbers: one collected row, for use on a stream."""
    row = df.agg(*[_stats_struct(c).alias(c) for c in columns]).first()
    return {c: (row[c]["mean"], row[c]["stddev"]) for c in columns}


def _outside(value: Column, mean: Column, deviation: Column, sigmas: float) -> Column:
    beyond = (value < mean - deviation * sigmas) | (value > mean + deviation * sigmas)
    return F.coalesce((deviation > 0) & beyond, F.lit(False))


def any_flag(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`") for c in columns], F.lit(False))


def flag_outliers(
    df: DataFrame,
    columns: list[str],
    sigmas: float = 3.0,
    by: list[str] | None = None,
    stats: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """``<column>_anomaly`` for values beyond ``sigmas`` deviations, and ``has_anomaly``.

    Global limits come from one scalar subquery over the table, per-group limits (``by``) from a joined
    aggregate, and ``stats`` supplies stored limits (needed on a stream, which has no global deviation).
    """
    flags = [f"{c}_anomaly" for c in columns]
    if by:
        packed = {f"__{c}": _stats_struct(c) for c in columns}
        joined = with_group_mean(df, by, packed)
        limits = {c: (F.col(f"__{c}.mean"), F.col(f"__{c}.stddev")) for c in columns}
    elif stats is not None:
        joined = df
        limits = {c: (F.lit(stats[c][0]).cast("double"), F.lit(stats[c][1]).cast("double")) for c in columns}
    else:
        joined = df
        one = df.agg(*[_stats_struct(c).alias(c) for c in columns])
        summary = one.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("s")).scalar()
        limits = {c: (summary[c]["mean"], summary[c]["stddev"]) for c in columns}
    flagged = joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[_outside(F.col(f"`{c}`").cast("double"), *limits[c], sigmas).alias(f) for c, f in zip(columns, flags)])
    return flagged.withColumn("has_anomaly", any_flag(flags))


def completeness_score(df: DataFrame, key_columns: list[str]) -> Column:
    """Share of the present key columns that are filled, in percent; 0 when none is present."""
    present = [c for c in key_columns if c in df.columns]
    if not present:
        return F.lit(0.0)
    filled = reduce(lambda a, b: a + b, [is_filled(F.col(f"`{c}`")).cast("int") for c in present])
    return filled.cast("double") / F.lit(float(len(present))) * F.lit(100.0)


def quality_score(df: DataFrame, key_columns: list[str], name: str = "data_quality_score") -> DataFrame:
    """Completeness score, reduced for rows flagged as anomalous."""
    score = completeness_score(df, key_columns)
    if "has_anomaly" in df.columns:
        score = F.when(F.col("has_anomaly"), score * F.lit(ANOMALY_PENALTY)).otherwise(score)
    return df.withColumn(name, score)


def completeness_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: rows, non-null values, percent filled, missing values, percent missing, type."""
    columns = columns or df.columns
    types = dict(df.dtypes)
    counted = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in columns])
    long = counted.unpivot(["__rows"], columns, "column_name", "filled")
    total, filled = F.col("__rows"), F.col("filled")
    type_of = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    return long.select(
        "column_name", total.alias("total_rows"), filled,
        F.coalesce(ratio(filled * 100, total), F.lit(0.0)).alias("filled_pct"),
        (total - filled).alias("missing"),
        F.coalesce(ratio((total - filled) * 100, total), F.lit(0.0)).alias("missing_pct"),
        F.element_at(type_of, F.col("column_name")).alias("type"))


def column_profile(df: DataFrame, columns: list[str] | None = None, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """Long profile: (column_name, entry, number_value, text_value, rows).

    Numeric columns give one row per statistic. Text columns, and numeric ones with fewer than ``limit``
    distinct values, give one row per distinct value, so a long list is never held in one place. Numeric
    columns with clearly more values are ruled out first by an approximate count (one collected row).
    """
    columns = columns or df.columns
    numeric = [c for c in columns if c in numeric_columns(df)]
    text = [c for c in columns if dict(df.dtypes)[c] == "string"]
    parts = []
    few = []
    if numeric:
        stats = column_stats(df, numeric)
        parts.append(
            stats.unpivot("column_name", list(STATS), "entry", "number_value")
            .select("column_name", "entry", "number_value",
                    F.lit(None).cast("string").alias("text_value"), F.lit(None).cast("bigint").alias("rows")))
        guess = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in numeric]).first()
        few = [c for c in numeric if guess[c] < 2 * limit]
    listed = text + few
    if listed:
        pairs = df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("text_value"))
            for c in listed])))
        values = pairs.where(F.col("text_value").isNotNull()).groupBy("column_name", "text_value").agg(
            F.count(F.lit(1)).alias("rows"))
        short = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).where(
            F.col("column_name").isin(*text) | (F.col("n") < limit)).select("column_name")
        parts.append(
            values.join(short, "column_name", "left_semi")
            .select("column_name", F.lit("value").alias("entry"),
                    F.lit(None).cast("double").alias("number_value"), "text_value", "rows"))
    return reduce(DataFrame.unionByName, parts)
