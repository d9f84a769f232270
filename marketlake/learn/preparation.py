"""Splits and preprocessing."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.ids import hash_share
from marketlake.functions.nulls import NUMERIC
from marketlake.operators.grouped import summarize

FEATURES = "features"
# Columns computed from the target or naming the row: never features.
TARGET_DERIVED = ("price_to_neighborhood_ratio", "neighborhood_avg_price", "neighborhood_median_price", "unit_price")


def split_share(id_column: str, seed: int = 42) -> Column:
    return hash_share(F.col(id_column), seed)


def train_test(df: DataFrame, id_column: str, train_pct: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the id: the same row lands on the same side on every run and partitioning."""
    share = split_share(id_column, seed)
    return df.where(share < train_pct), df.where(share >= train_pct)


def with_folds(df: DataFrame, id_column: str, folds: int = 3, seed: int = 7) -> DataFrame:
    """Fold number from a hash of the id, for repeatable cross-validation."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(folds)).cast("int"))


def feature_columns(df: DataFrame, target: str, id_column: str) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature names: every usable column but the id, the target and what derives from it."""
    skipped = {target, id_column, *TARGET_DERIVED}
    fields = [f for f in df.schema.fields if f.name not in skipped]
    numeric = [f.name for f in fields if isinstance(f.dataType, NUMERIC)]
    categorical = [f.name for f in fields if f.dataType.simpleString() == "string"]
    return numeric, categorical


def most_frequent(df: DataFrame, columns: list[str], at_most: int | None = None) -> dict[str, str]:
    """Mode of each text column (ties: first in text order). Values are counted map-side; one row per column
    reaches the driver. With ``at_most``, a column with more values raises."""
    if not columns:
        return {}
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")) for c in columns])))
    counted = pairs.where(F.col("value").isNotNull()).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("name").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"), F.count(F.lit(1)).alias("values")).collect()
    wide = [row["name"] for row in best if at_most is not None and row["values"] > at_most]
    if wide:
        raise ValueError(f"more than {at_most} categories in {wide}")
    modes = {row["name"]: row["value"] for row in best}
    return {c: modes[c] for c in columns if c in modes}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median of each numeric column over its values (nulls and NaN are missing), 0 for a column without any.

    Columns are the groups of one summary, which keeps no more of a group in a task than a bracket around its middle.
    """
    if not columns:
        return {}
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), _present(c).alias("value")) for c in columns])))
    found = {r["name"]: r["median"] for r in summarize(pairs, ["name"], {}, {"median": "value"}).collect()}  # one row a column
    return {c: 0.0 if found.get(c) is None else float(found[c]) for c in columns}


def _present(column: str) -> Column:
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def imputed(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """The columns as numbers, with the median for missing values; other columns stay."""
    return df.withColumns({c: F.coalesce(_present(c), F.lit(m)) for c, m in medians.items()})


def preprocessing(medians: dict[str, float], modes: dict[str, str]) -> Pipeline:
    """``medians`` and ``modes`` map each numeric and text column to what stands for its missing values. Numbers are then standardised,
    texts one-hot with unknown values as all zeros. Ends in one ``features`` vector; the stages save and load with the model."""
    numeric, categorical = list(medians), list(modes)
    numbers = {c: f"CAST(`{c}` AS DOUBLE)" for c in numeric}
    casts = [f"CASE WHEN {x} IS NULL OR isnan({x}) THEN {medians[c]!r}D ELSE {x} END AS `{c}__full`" for c, x in numbers.items()]
    fills = [f"coalesce(`{c}`, {_quoted(modes[c])}) AS `{c}__text`" for c in categorical]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(casts + fills)} FROM __THIS__")]
    vectors = []
    if numeric:
        stages += [
            VectorAssembler(inputCols=[f"{c}__full" for c in numeric], outputCol="numbers"),
            StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True)]
        vectors.append("scaled")
    if categorical:
        stages += [
            StringIndexer(inputCols=[f"{c}__text" for c in categorical], outputCols=[f"{c}__index" for c in categorical],
                          handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=[f"{c}__index" for c in categorical], outputCols=[f"{c}__hot" for c in categorical])]
        vectors += [f"{c}__hot" for c in categorical]
    stages.append(VectorAssembler(inputCols=vectors, outputCol=FEATURES))
    return Pipeline(stages=stages)
