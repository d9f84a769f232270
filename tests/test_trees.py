"""Trees grown in one task against Spark's own fits."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from marketlake.learn import models as lm
from marketlake.learn import preparation, search, trees


@pytest.fixture(scope="module")
def frame(spark):
    dice = random.Random(5)
    data = []
    for i in range(900):
        x, step, kind = dice.gauss(5, 2), dice.randrange(4), dice.choice(["big", "small", "odd"])
        price = 100 + 20 * x * (step > 1) + {"big": 60, "small": 0, "odd": 30}[kind] + dice.gauss(0, 9)
        data.append((i, price, x, step, None if i % 40 == 0 else kind, dice.choice("ab")))
    return spark.createDataFrame(data, "id bigint, price double, x double, step int, kind string, side string").cache()


@pytest.fixture(scope="module")
def rows(frame):
    ready = preparation.preprocessing(preparation.exact_medians(frame, ["x", "step"]), {"kind": "big", "side": "a"}).fit(frame).transform(frame)
    return preparation.with_folds(ready, "id").selectExpr("features", "price as label", "fold").cache()


@pytest.fixture(scope="module")
def packed(rows):
    return trees.pack(rows, rows.count())


def predictions(model, rows):
    return np.array([r.prediction for r in model.transform(rows).select("label", "prediction").orderBy("label", "prediction").collect()])


def error(model, rows):
    return model.transform(rows).agg(F.avg(F.pow(F.col("label") - F.col("prediction"), 2))).first()[0]


def test_packed_rows_hold_every_value(rows, packed):
    table = trees.Packed(packed.toArrow())
    features = {}
    for slots, values, codes in table.columns:
        for k, slot in enumerate(slots):
            features[slot] = codes == k + 1 if values is None else values[codes]
    found = sorted(zip(table.label, table.fold, *[features[k] for k in sorted(features)], strict=True))
    assert found == sorted((r.label, r.fold, *r.features.toArray()) for r in rows.collect())
    assert len(table.columns) == 4  # the exclusive slots of a text share a column


@pytest.mark.parametrize("least,depth", [(7, 9), (1, 30)])
def test_tree_is_sparks(rows, packed, least, depth):
    table = trees.Packed(packed.toArrow())
    every = np.arange(len(table.label))
    x = table.binned(every, 32)
    levels = trees.grow(x, every, table.label, None, depth, least, x.size, None)
    cut = trees.predicted(x, levels, every, [2, depth])
    for d, mine in zip((2, depth), cut, strict=True):
        own = DecisionTreeRegressor(maxDepth=min(d, depth), minInstancesPerNode=least).fit(rows.coalesce(1))
        order = np.lexsort([mine, table.label])
        assert mine[order] == pytest.approx(predictions(own, rows), rel=1e-9)


def test_boosting_search_and_fit_are_sparks(rows, packed):
    estimator = GBTRegressor(seed=42, stepSize=0.3)
    fits = [({"maxDepth": 2}, 0), ({"maxDepth": 4}, 1)]
    found = trees.boosting_search(packed, estimator, fits, [2, 5])
    for (params, fold), errors in zip(fits, found, strict=True):
        own = GBTRegressor(seed=42, stepSize=0.3, maxIter=5, **params).fit(rows.where(f"fold != {fold}").coalesce(1))
        want = own.evaluateEachIteration(rows.where(f"fold = {fold}"), "squared")
        # Of splits that are equally good but for rounding either may be taken; deeper trees meet such ties.
        assert errors == pytest.approx({(2,): want[1], (5,): want[4]}, rel=1e-9 if params["maxDepth"] == 2 else 0.01)
    chosen = GBTRegressor(seed=42, stepSize=0.3, maxIter=4, maxDepth=3)
    mine, own = trees.fit_boosting(packed, rows, chosen), chosen.fit(rows.coalesce(1))
    assert predictions(mine, rows) == pytest.approx(predictions(own, rows), rel=1e-9)
    assert (mine.getMaxIter(), mine.getMaxDepth(), mine.getStepSize(), mine.numFeatures) == (4, 3, 0.3, own.numFeatures)
    assert mine.treeWeights == own.treeWeights and mine.featureImportances.toArray() == pytest.approx(own.featureImportances.toArray(), abs=1e-3)


def test_forest_is_a_spark_forest_as_good_as_sparks(rows, packed, tmp_path):
    estimator = RandomForestRegressor(seed=42, numTrees=40, maxDepth=8, minInstancesPerNode=2)
    mine, own = trees.fit_forest(packed, rows, estimator), estimator.fit(rows)
    assert mine.getNumTrees == 40 and max(t.depth for t in mine.trees) == 8 and mine.getMinInstancesPerNode() == 2
    each = [predictions(t, rows.select("features", F.lit(0.0).alias("label"))) for t in mine.trees[:3]]
    assert not np.allclose(each[0], each[1])  # bags and drawn slots differ by tree
    assert error(mine, rows) == pytest.approx(error(own, rows), rel=0.15)
    assert mine.featureImportances.toArray() == pytest.approx(own.featureImportances.toArray(), abs=0.06)
    mine.write().save(str(tmp_path / "forest"))
    assert np.allclose(predictions(type(mine).load(str(tmp_path / "forest")), rows), predictions(mine, rows))


def test_forest_errors_are_those_of_the_grown_trees(rows, packed):
    estimator = RandomForestRegressor(seed=42)
    found = trees.forest_search(packed, estimator, [({"minInstancesPerNode": 3}, 1)], [2, 5], [30, 3])[0]
    table = trees.Packed(packed.toArrow())
    train, held = np.flatnonzero(table.fold != 1), np.flatnonzero(table.fold == 1)
    x, sums = table.binned(train, 32), {}
    for tree in range(5):
        w, rng = trees._bag(table, train, 42, tree)
        y = table.label - table.label[train].mean()
        levels = trees.grow(x, np.flatnonzero(w), y, w, 30, 3, 3, rng)
        assert all(c.min() >= 3 for c in (v.count for v in levels))
        for d, values in zip((3, 30), trees.predicted(x, levels, held, [3, 30]), strict=True):
            sums[d] = sums.get(d, 0) + values
            if tree + 1 in (2, 5):
                assert found[tree + 1, d] == pytest.approx(((sums[d] / (tree + 1) - y[held]) ** 2).mean(), rel=1e-9)


def test_search_fits_no_forest_by_levels(rows, monkeypatch):
    """Rows that fit a task: no fit of the search goes through Spark's jobs a level."""
    def never(estimator):
        raise AssertionError("fitted level by level")

    monkeypatch.setattr(search, "tuned", never)
    with ThreadPoolExecutor(2) as pool:
        grid = {"numTrees": [4, 2], "maxDepth": [30, 3], "minInstancesPerNode": [1, 2]}
        found = search.search_forest(pool, RandomForestRegressor(seed=1), rows, rows.count(), grid, 3)()
        again = search.search_forest(pool, RandomForestRegressor(seed=1), rows.repartition(7), rows.count(), grid, 3)()
        rounds = search.search_boosting(pool, GBTRegressor(seed=1), rows, rows.count(), {"maxIter": [2, 4], "stepSize": [0.1, 0.2]}, 3)()
    assert [p for p, _ in found.errors] == search.points(grid) and found == again
    assert len(rounds.errors) == 4 and rounds.best == {"maxIter": 4, "stepSize": 0.2}


def test_rows_beyond_a_task_are_fitted_by_spark(frame, monkeypatch):
    grids = {lm.FOREST: {"numTrees": [3], "maxDepth": [2, 4]}, lm.BOOSTING: {"maxIter": [2, 3]}}
    used, tuned = [], search.tuned
    monkeypatch.setattr(trees, "MOST_BYTES", 1000)
    monkeypatch.setattr(search, "tuned", lambda e: used.append(e) or tuned(e))
    found = lm.fit(frame, "price", "id", ["x", "step"], ["kind"], [lm.FOREST, lm.BOOSTING], grids)
    assert len(used) == 3 + 3 + 2 and [len(f.searched) for f in found] == [2, 2]


def test_missing_labels_are_refused(spark, rows):
    with pytest.raises(Exception, match="must not be null"):
        trees.pack(rows.withColumn("label", F.when(F.col("label") > 200, F.col("label"))), rows.count()).count()


def test_permuted_copies_are_scored_by_many_tasks(frame, monkeypatch):
    fitted, = lm.fit(frame, "price", "id", ["x", "step"], ["kind"], [lm.LINEAR])
    want = lm.permutation_importance(fitted, frame, "price", "id", repeats=2)
    parts, scored = [], lm.regression_metrics
    monkeypatch.setattr(lm, "regression_metrics", lambda df, *a: parts.append(df.rdd.getNumPartitions()) or scored(df, *a))
    monkeypatch.setattr(lm, "COPIES_PER_PART", 100)
    assert lm.permutation_importance(fitted, frame, "price", "id", repeats=2) == pytest.approx(want, rel=1e-9)
    assert parts[0] >= 2 * 27  # 2 repeats of 900 rows and 3 columns


@pytest.mark.parametrize("depth,spark_fits", [(10, 1), (11, 0)])
def test_shallow_models_are_sparks_own_fit(frame, monkeypatch, depth, spark_fits):
    used, tuned = [], search.tuned
    monkeypatch.setattr(search, "tuned", lambda e: used.append(e) or tuned(e))
    model, = lm.fit(frame, "price", "id", ["x", "step"], ["kind"], [lm.FOREST], {lm.FOREST: {"numTrees": [2], "maxDepth": [depth]}})
    assert len(used) == spark_fits and model.params == {"numTrees": 2, "maxDepth": depth}
