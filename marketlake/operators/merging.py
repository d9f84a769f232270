"""Keyed merges, de-duplication, reconciliation and key checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in ``order``.

    An aggregate, not a row-number window: copies of one key combine map-side before the shuffle.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    position = F.struct(*[F.col(c) for c in order])
    pick = F.max_by(row, position) if last else F.min_by(row, position)
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(pick.alias("__row")).select("__row.*")


def one_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order`` (ties: by the hash of the row); a row with a null key names nothing and stays."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    tied = df.where(known).withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return keep_one(tied, keys, [*order, "__tie"]).drop("__tie").unionByName(df.where(~known))


def _single(batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch itself; a key that it names twice raises, since nothing says which row holds."""
    row = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
    grouped = batch.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        F.any_value(row).alias("__row"), F.count(F.lit(1)).alias("__n"))
    twice = F.raise_error(F.lit(f"a key of {keys} is twice in the batch; name an order")).cast("boolean")
    return grouped.where(F.when(F.col("__n") > 1, twice).otherwise(True)).select("__row.*")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Target with every row whose key is in the batch replaced by the batch's row.

    With ``order``, the last row of a key holds, whether it comes from the batch or, if the target has the order's columns,
    from the target: a late row never replaces a newer one. Without, the batch holds and must name each key once.
    """
    if not order:
        single = _single(batch, keys)
        return target.join(batch.select(*keys), keys, "left_anti").unionByName(single.select(*target.columns))
    if not set(order) <= set(target.columns):
        latest = keep_one(batch, keys, order, last=True)
        return target.join(latest.select(*keys), keys, "left_anti").unionByName(latest.select(*target.columns))
    return keep_one(target.unionByName(batch.select(*target.columns)), keys, order, last=True)


def combine_sources(batch: DataFrame, stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Both sources in one table, one row per key; the batch source wins over the stream."""
    tagged = batch.withColumn("__rank", F.lit(0)).unionByName(
        stream.withColumn("__rank", F.lit(1)), allowMissingColumns=True)
    return keep_one(tagged, [key], ["__rank", *order]).drop("__rank")


def reconcile(batch: DataFrame, stream: DataFrame, key: str) -> DataFrame:
    """How many ids are in both sources, only in the batch, only in the stream."""
    sides = (
        batch.select(key, F.lit(True).alias("b"), F.lit(False).alias("s"))
        .union(stream.select(key, F.lit(False), F.lit(True)))
        .groupBy(key).agg(F.bool_or("b").alias("b"), F.bool_or("s").alias("s")))
    side = F.when(F.col("b") & F.col("s"), "both").when(F.col("b"), "batch_only").otherwise("stream_only")
    return sides.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("ids"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    known = parent.select(F.col(parent_key).alias("__parent"))
    return child.where(F.col(child_key).isNotNull()).join(known, F.col(child_key) == F.col("__parent"), "left_anti")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per column, one row per column, from one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], columns, "column_name", "nulls")


def key_violations(
    df: DataFrame,
    name: str,
    unique: list[list[str]] = (),
    not_null: list[str] = (),
    references: list[tuple[str, DataFrame, str]] = (),
) -> DataFrame:
    """One row per declared rule: (table_name, rule, violations)."""
    def rule(source: DataFrame, text: str, amount) -> DataFrame:
        return source.agg(amount.cast("bigint").alias("violations")).select(
            F.lit(name).alias("table_name"), F.lit(text).alias("rule"), "violations")

    checks = [rule(duplicate_keys(df, list(keys)), f"unique({','.join(keys)})", F.count(F.lit(1))) for keys in unique]
    if not_null:
        counts = null_counts(df, list(not_null))
        checks.append(counts.select(
            F.lit(name).alias("table_name"),
            F.concat(F.lit("not_null("), F.col("column_name"), F.lit(")")).alias("rule"),
            F.col("nulls").cast("bigint").alias("violations")))
    for column, parent, parent_key in references:
        checks.append(rule(orphans(df, parent, column, parent_key), f"foreign_key({column})", F.count(F.lit(1))))
    return reduce(DataFrame.unionByName, checks)
