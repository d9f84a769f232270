"""Fitting, metrics, selection and importance of price models."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions.numbers import ratio
from marketlake.learn import search, trees
from marketlake.learn.preparation import FEATURES, exact_medians, most_frequent, preprocessing, with_folds

# The published search grids; a depth of 30 is Spark's largest and stands for "no limit".
FOREST_GRID = {"numTrees": [50, 100], "maxDepth": [30, 10, 20], "minInstancesPerNode": [1, 2]}
BOOSTING_GRID = {"maxIter": [50, 100], "stepSize": [0.05, 0.1], "maxDepth": [3, 5]}
LINEAR, FOREST, BOOSTING = "Linear Regression", "Random Forest", "Gradient Boosting"
METRICS = ("rmse", "mae", "r2", "explained_variance")
SEARCHES = {FOREST: search.search_forest, BOOSTING: search.search_boosting}
#: Fits that run side by side at most (each may ask ``search.NODE_MEMORY_MB`` of memory), and rows of a partition of a last fit.
MOST_FITS = 6
FINAL_ROWS_PER_PART = 4000
#: Copies of permuted rows that one task scores, about.
COPIES_PER_PART = 40_000


@dataclass
class Fitted:
    """A fitted model: preprocessing and regressor in one pipeline model, with what was chosen and measured."""

    name: str
    model: PipelineModel
    numeric: list[str]
    categorical: list[str]
    params: dict
    metrics: dict[str, float] = field(default_factory=dict)
    #: (grid point, cross-validated mean squared error) of everything that was searched.
    searched: list[tuple[dict, float]] = field(default_factory=list)

    @property
    def regressor(self):
        return self.model.stages[-1]


def regressors(seed: int = 42) -> dict[str, tuple]:
    """name → (estimator, search grid)."""
    return {
        LINEAR: (LinearRegression(featuresCol=FEATURES, regParam=0.0), {}),
        FOREST: (RandomForestRegressor(featuresCol=FEATURES, seed=seed), FOREST_GRID),
        BOOSTING: (GBTRegressor(featuresCol=FEATURES, seed=seed), BOOSTING_GRID)}


def _chosen(model, names) -> dict:
    return {n: model.getOrDefault(n) for n in names if model.hasParam(n)}


def fit(
    train: DataFrame,
    target: str,
    id_column: str,
    numeric: list[str],
    categorical: list[str],
    names: list[str] | None = None,
    grids: dict[str, dict] | None = None,
    folds: int = 3,
    parallelism: int | None = None,
) -> list[Fitted]:
    """Fit the named models. Training rows, raw and prepared, are kept while they are read again and again;
    lost blocks are recomputed. Grids with more than one point are searched by cross-validation on hash folds, with ensembles
    shared by the points they contain (``search``); the best point is then fitted on all rows. ``parallelism`` of Spark's own fits run at a time."""
    source = train.select(id_column, target, *numeric, *categorical).persist(StorageLevel.MEMORY_AND_DISK)
    cores = train.sparkSession.sparkContext.defaultParallelism
    rows, packed, found = None, None, {}
    try:
        modes = most_frequent(source, categorical)
        prepare = preprocessing(exact_medians(source, numeric), modes).fit(source)
        rows = with_folds(prepare.transform(source), id_column, folds).select(
            FEATURES, F.col(target).cast("double").alias("label"), "fold").persist(StorageLevel.MEMORY_AND_DISK)
        count = rows.count()
        whole = rows.repartition(max(1, min(cores, count // FINAL_ROWS_PER_PART)))
        ensembles = [estimator for name, (estimator, _) in regressors().items() if name in SEARCHES and (not names or name in names)]
        packed = trees.pack(rows, count, *ensembles) if ensembles else None
        with ThreadPoolExecutor(parallelism or max(2, min(cores, MOST_FITS))) as pool, ThreadPoolExecutor(len(SEARCHES) + 1) as finals:
            for name, (estimator, default_grid) in regressors().items():
                if names and name not in names:
                    continue
                grid = (grids or {}).get(name, default_grid)
                started = SEARCHES[name](pool, estimator, rows, count, grid, folds, packed) if len(search.points(grid)) > 1 else None
                found[name] = finals.submit(_final, name, estimator, whole, grid, started, packed)
            fitted = {name: f.result() for name, f in found.items()}
    finally:
        for kept in (packed, rows, source):
            if kept is not None:
                kept.unpersist()
    return [
        Fitted(name, PipelineModel([*prepare.stages, model]), numeric, list(modes), params, searched=searched)
        for name, (model, params, searched) in fitted.items()]


def _final(name: str, estimator, rows: DataFrame, grid: dict, started: Callable[[], search.Searched] | None, packed: DataFrame | None) -> tuple:
    """The model of the best point on all rows, its parameters, and the errors of all points."""
    searched = started() if started else search.Searched([(p, float("nan")) for p in search.points(grid)])
    chosen = estimator.copy({getattr(estimator, k): v for k, v in searched.best.items()})
    model = search.fitted(chosen, rows, packed) if name in SEARCHES else chosen.fit(rows)
    return model, _chosen(model, grid or ["fitIntercept"]), searched.errors if started else []


def regression_metrics(df: DataFrame, label: str, prediction: str, by: list[str] = ()) -> DataFrame:
    """RMSE, MAE, R² and explained variance from one aggregate."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    error = y - p
    sums = df.groupBy(*by).agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"),
        F.var_pop(error).alias("error_variance"), F.var_pop(y).alias("label_variance"))
    return sums.select(
        *by, F.sqrt("mse").alias("rmse"), "mae",
        (F.lit(1.0) - ratio(F.col("mse"), F.col("label_variance"))).alias("r2"),
        (F.lit(1.0) - ratio(F.col("error_variance"), F.col("label_variance"))).alias("explained_variance"))


def evaluate(fitted: Fitted, test: DataFrame, target: str) -> dict[str, float]:
    row = regression_metrics(fitted.model.transform(test), target, "prediction").first()
    fitted.metrics = {m: row[m] for m in METRICS}
    return fitted.metrics


def best_of(metrics: DataFrame) -> DataFrame:
    """The row with the highest R²; among equals the first name."""
    return metrics.orderBy(F.desc_nulls_last("r2"), "model_name").limit(1)


def vector_sources(df: DataFrame) -> list[str]:
    """Source column of every slot of the feature vector, read from the vector's attribute names."""
    groups = df.schema[FEATURES].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a.get("name", "")) for attrs in groups.values() for a in attrs)
    return [name for _, name in slots]


def native_importance(fitted: Fitted, sample: DataFrame) -> dict[str, float]:
    """Importance per source column: tree importances, or coefficient shares, summed over one-hot slots."""
    regressor = fitted.regressor
    if hasattr(regressor, "featureImportances"):
        weights = list(regressor.featureImportances.toArray())
    else:
        sizes = [abs(c) for c in regressor.coefficients.toArray()]
        weights = [s / (sum(sizes) or 1.0) for s in sizes]
    # The scaled numbers carry no names; they come first, in the order of the numeric columns.
    names = vector_sources(fitted.model.transform(sample.limit(0)))
    shares: dict[str, float] = {}
    for i, weight in enumerate(weights):
        if i < len(fitted.numeric):
            source = fitted.numeric[i]
        else:
            source = next(c for c in fitted.categorical if names[i].startswith(f"{c}__hot_"))
        shares[source] = shares.get(source, 0.0) + float(weight)
    return dict(sorted(shares.items(), key=lambda item: (-item[1], item[0])))


def shuffled(df: DataFrame, columns: list[str], id_column: str, seed: int, groups: int) -> DataFrame:
    """``__next``: the columns' values of another row, as a permutation of the rows.

    Rows fall into random groups, each group is put in random order, and every row takes the values of the row
    after it (the last takes the first). No sort of the whole table, no join.
    """
    placed = df.withColumns({
        "__group": F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(groups)),
        "__spot": F.xxhash64(F.col(id_column), F.lit(seed + 1))})
    order = Window.partitionBy("__group").orderBy("__spot", id_column)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    values = F.struct(*[F.col(f"`{c}`") for c in columns])
    return placed.withColumn("__next", F.coalesce(F.lead(values).over(order), F.first(values).over(whole))).drop(
        "__group", "__spot")


def permutation_importance(
    fitted: Fitted, test: DataFrame, target: str, id_column: str, columns: list[str] | None = None,
    repeats: int = 10, seed: int = 42, rows_per_group: int = 100_000,
) -> dict[str, float]:
    """Mean drop of R² when a column is permuted among the test rows.

    Each repeat permutes all columns with one window and copies every row once per column, with that column
    exchanged. All copies are scored together and R² is one aggregate by column: repeats share the labels, so
    the R² of their joint mean squared error is the mean of their R². The permuted rows are dealt out anew
    before they are copied: a group's window is one task, its copies are scored by many.
    """
    columns = columns or fitted.numeric + fitted.categorical
    needed = list(dict.fromkeys([*fitted.numeric, *fitted.categorical]))
    test = test.select(id_column, target, *needed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        count = test.count()
        groups, parts = max(1, count // rows_per_group), max(1, -(-count * len(columns) // COPIES_PER_PART))
        copies = test.select(F.lit("").alias("__tag"), target, *needed)
        for repeat in range(repeats):
            moved = shuffled(test, columns, id_column, seed + 17 * repeat, groups).repartition(parts)
            exchanged = F.array(*[
                F.struct(F.lit(c).alias("__tag"),
                         *[(F.col("__next")[n] if n == c else F.col(f"`{n}`")).alias(n) for n in needed]) for c in columns])
            copies = copies.unionByName(moved.select(target, F.inline(exchanged)))
        scored = regression_metrics(fitted.model.transform(copies), target, "prediction", ["__tag"])
        r2 = {row["__tag"]: row["r2"] for row in scored.collect()}  # one row per column
    finally:
        test.unpersist()
    drops = {c: r2[""] - r2[c] for c in columns}
    return dict(sorted(drops.items(), key=lambda item: (-item[1], item[0])))


def save(fitted: Fitted, path: str) -> str:
    fitted.model.write().overwrite().save(path)
    return path


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
