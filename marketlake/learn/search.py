"""Cross-validated grid search that shares ensembles: one fit answers all grid points that it contains.

* The first n rounds of a boosted model are the model of n rounds, so one fit of the most rounds gives the error after each.
* The first n trees of a forest are a forest of n trees, and a tree whose splits below a depth are taken back (inner nodes know
  the mean of their rows) is a tree of that depth. One fit of the most trees and the largest depth so gives the error of every
  smaller number and depth. Such a forest is a valid fit of its grid point, drawn from other random numbers than a fit of its own.

All other parameters need fits of their own. Rows that fit a task are packed, and trees and fits are grown side by side there (``trees``).
Beyond that Spark's distributed fits of different points and folds run side by side, each over few partitions: every partition keeps
statistics of all open nodes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Executor
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.learn import trees
from marketlake.session import shared_dir
from marketlake.sources.files import file_system

#: Rows of a partition of training rows, about.
ROWS_PER_PART = 50_000
#: Memory for the statistics of open nodes that one fit asks of a task, in MB.
NODE_MEMORY_MB = 512
#: Depth up to which the model of the chosen point is Spark's own fit.
SHALLOW = 10
#: Levels between checkpoints of the node ids; without them the lineage of a deep forest grows with its depth.
CHECKPOINT_LEVELS = 10


@dataclass(frozen=True)
class Searched:
    """Mean of the folds' mean squared errors of each grid point, in grid order, and the best (of equals the first)."""

    errors: list[tuple[dict, float]]

    @property
    def best(self) -> dict:
        return min(self.errors, key=lambda e: e[1])[0]


def tuned(estimator):
    """Settings that change how a forest is fitted, not what is fitted: node ids stay with the rows. Shallow boosted trees gain nothing by them."""
    if not isinstance(estimator, RandomForestRegressor):
        return estimator
    return estimator.copy({
        estimator.cacheNodeIds: True, estimator.maxMemoryInMB: NODE_MEMORY_MB, estimator.checkpointInterval: CHECKPOINT_LEVELS})


def points(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def leaf_values(nodes: DataFrame, depths: list[int]) -> DataFrame:
    """``(tree, leaf, d<depth>...)``: what each leaf predicts once its tree is cut at the depths; leaves are numbered from the left.

    Nodes are numbered from the top, left before right, so a tree's leaves in order of their numbers are its leaves from the left.
    One tree is one group: the driver that fitted it holds all of them anyway.
    """
    names = [f"d{d}" for d in depths]
    schema = "tree int, leaf int, " + ", ".join(f"{n} double" for n in names)

    def cut(table: pa.Table) -> pa.Table:
        order = np.argsort(table["id"].to_numpy())
        left, right, value = (table[c].to_numpy()[order] for c in ("left", "right", "prediction"))
        cuts = np.tile(value, (len(depths), 1))
        level, at = 0, np.zeros(1, np.int64)
        while len(at):
            at = at[left[at] >= 0]
            for side in (left, right):
                for row, depth in zip(cuts, depths, strict=True):
                    if level >= depth:
                        row[side[at]] = row[at]
            at, level = np.concatenate([left[at], right[at]]), level + 1
        leaves = np.flatnonzero(left < 0)
        return pa.table({
            "tree": pa.array(np.full(len(leaves), table["tree"][0].as_py(), np.int32)), "leaf": pa.array(np.arange(len(leaves), dtype=np.int32)),
            **{n: pa.array(row[leaves]) for n, row in zip(names, cuts, strict=True)}})

    return nodes.groupBy("tree").applyInArrow(cut, schema)


def forest_errors(model: RandomForestRegressionModel, rows: DataFrame, sizes: list[int], depths: list[int]) -> dict[tuple[int, int], float]:
    """Mean squared error on ``rows`` (``features``, ``label``) of the forest's first ``size`` trees cut at ``depth``, for all of them."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/model-search/{uuid.uuid4().hex}"
    model.write().save(path)
    try:
        saved = spark.read.parquet(f"{path}/data")
        node = F.col("nodeData") if "nodeData" in saved.columns else F.struct(*[F.col(c) for c in saved.columns if c != "treeID"])
        nodes = saved.select(
            F.col("treeID").alias("tree"), node["id"].alias("id"), node["prediction"].alias("prediction"), node["leftChild"].alias("left"),
            node["rightChild"].alias("right"))
        scored = model.setLeafCol("__leaves").transform(rows.select("features", "label"))
        scored = scored.withColumn("row", F.monotonically_increasing_id())
        scored = scored.select("label", "row", F.posexplode(vector_to_array("__leaves")).alias("tree", "leaf"))
        names = {(n, d): f"n{n}_d{d}" for n in sizes for d in depths}
        found = scored.withColumn("leaf", F.col("leaf").cast("int")).join(leaf_values(nodes, depths), ["tree", "leaf"])
        by_row = found.groupBy("row").agg(
            F.any_value("label").alias("label"), *[F.avg(F.when(F.col("tree") < n, F.col(f"d{d}"))).alias(c) for (n, d), c in names.items()])
        means = by_row.agg(*[F.avg(F.pow(F.col("label") - F.col(c), 2)).alias(c) for c in names.values()]).first()
    finally:
        fs, target = file_system(spark, path)
        fs.delete(target, True)
    return {key: means[c] for key, c in names.items()}


def _search(
    pool: Executor, estimator, rows: DataFrame, count: int, grid: dict[str, list], folds: int, inner: tuple[str, ...], errors, packed_errors,
    packed: DataFrame | None,
) -> Callable[[], Searched]:
    """Start one fit for each fold and combination of the parameters that are not ``inner``; the result waits for them.

    ``errors(model, held rows, values of the inner parameters)`` gives the error of each combination of inner values, and
    ``packed_errors(packed rows, estimator, all fits, values of the inner parameters)`` those of all fits.
    """
    values = [grid.get(k, [estimator.getOrDefault(k)]) for k in inner]
    outer = points({k: v for k, v in grid.items() if k not in inner})
    fits = [(params, fold) for params in outer for fold in range(folds)]

    def one(params: dict, fold: int) -> dict[tuple, float]:
        largest = params | {k: max(v) for k, v in zip(inner, values, strict=True)}
        train = rows.where(F.col("fold") != fold).coalesce(max(1, -(-count // ROWS_PER_PART)))
        model = tuned(estimator).copy({getattr(estimator, k): v for k, v in largest.items()}).fit(train)
        return errors(model, rows.where(F.col("fold") == fold), *values)

    packed = trees.pack(rows, count, estimator) if packed is None else packed
    if packed is not None:
        whole = pool.submit(packed_errors, packed, estimator, fits, *values)
        found = whole.result
    else:
        started = [pool.submit(one, params, fold) for params, fold in fits]

        def found() -> list[dict[tuple, float]]:
            return [p.result() for p in started]

    def gathered() -> Searched:
        mean = {}
        for (params, _), parts in zip(fits[::folds], _grouped(found(), folds), strict=True):
            for key in parts[0]:
                whole = params | dict(zip(inner, key, strict=True))
                mean[tuple(whole[k] for k in grid)] = sum(f[key] for f in parts) / folds
        return Searched([(p, mean[tuple(p.values())]) for p in points(grid)])

    return gathered


def _grouped(values: list, size: int) -> list[list]:
    return [values[k:k + size] for k in range(0, len(values), size)]


def search_forest(
    pool: Executor, estimator: RandomForestRegressor, rows: DataFrame, count: int, grid: dict[str, list], folds: int, packed: DataFrame | None = None
):
    """Numbers of trees and depths share a fit. ``rows`` has ``features``, ``label`` and ``fold``, ``count`` rows in all; ``packed`` are the same."""
    return _search(pool, estimator, rows, count, grid, folds, ("numTrees", "maxDepth"), forest_errors, trees.forest_search, packed)


def boosting_errors(model: GBTRegressionModel, rows: DataFrame, rounds: list[int]) -> dict[tuple[int], float]:
    """Mean squared error on ``rows`` after each number of rounds."""
    errors = model.evaluateEachIteration(rows.select("features", "label"), "squared")
    return {(n,): errors[n - 1] for n in rounds}


def search_boosting(
    pool: Executor, estimator: GBTRegressor, rows: DataFrame, count: int, grid: dict[str, list], folds: int, packed: DataFrame | None = None
):
    """Numbers of rounds share a fit."""
    return _search(pool, estimator, rows, count, grid, folds, ("maxIter",), boosting_errors, trees.boosting_search, packed)


def fitted(estimator, rows: DataFrame, packed: DataFrame | None):
    """The estimator's model of all rows: Spark's own fit, whose random draws and split candidates it keeps, while its trees are shallow.

    Deeper trees have too many open nodes for a job a level; they are grown from the packed rows, if there are any.
    """
    if packed is None or estimator.getMaxDepth() <= SHALLOW:
        return tuned(estimator).fit(rows)
    return (trees.fit_forest if isinstance(estimator, RandomForestRegressor) else trees.fit_boosting)(packed, rows, estimator)
