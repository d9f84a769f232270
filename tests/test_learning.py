from __future__ import annotations

import random
from datetime import datetime

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from marketlake.learn import models as lm
from marketlake.learn import preparation, scoring, search
from marketlake.sources import contracts


@pytest.fixture(scope="module")
def frame(spark):
    dice = random.Random(1)
    data = []
    for i in range(400):
        x, kind = dice.gauss(5, 2), dice.choice(["big", "small", "odd's"])
        price = 100 + 20 * x + {"big": 60, "small": 0, "odd's": 30}[kind] + dice.gauss(0, 1)
        data.append((i, price, None if i % 50 == 0 else x, dice.random(), None if i % 40 == 0 else kind))
    return spark.createDataFrame(data, "id bigint, price double, x double, noise double, kind string").cache()


def test_split_is_disjoint_whole_and_stable(frame):
    train, test = preparation.train_test(frame, "id")
    assert train.count() + test.count() == frame.count() and train.join(test, "id").count() == 0
    again, _ = preparation.train_test(frame.repartition(13), "id")
    assert {r.id for r in again.collect()} == {r.id for r in train.collect()}
    assert 0.7 < train.count() / frame.count() < 0.9


def test_features_leave_out_id_and_target_derivatives(frame):
    derived = frame.withColumn("price_to_neighborhood_ratio", F.lit(1.0))
    assert preparation.feature_columns(derived, "price", "id") == (["x", "noise"], ["kind"])


def test_modes_and_width_limit(frame, spark):
    counts = {r.kind: r["count"] for r in frame.where("kind is not null").groupBy("kind").count().collect()}
    assert preparation.most_frequent(frame, ["kind"]) == {"kind": max(counts, key=lambda k: counts[k])}
    with pytest.raises(ValueError):
        preparation.most_frequent(spark.range(20).select(F.col("id").cast("string").alias("t")), ["t"], at_most=5)


def test_preparation_standardises_and_encodes(frame):
    prepared = preparation.preprocessing(preparation.exact_medians(frame, ["x", "noise"]), {"kind": "big"}).fit(frame)
    vectors = np.array([r.features.toArray() for r in prepared.transform(frame).select("features").collect()])
    assert vectors.shape == (400, 2 + 3)
    assert np.allclose(vectors[:, :2].mean(axis=0), 0, atol=1e-9) and np.allclose(vectors[:, :2].std(axis=0, ddof=1), 1)
    assert set(vectors[:, 2:].sum(axis=1)) == {1.0}
    unknown = frame.limit(1).withColumn("kind", F.lit("never seen"))
    assert prepared.transform(unknown).first().features.toArray()[2:].sum() == 0.0


def test_medians_are_exact(spark):
    dice = random.Random(3)
    rows = [(dice.gauss(0, 1) if k % 7 else None, float(k % 5), None, float("nan") if k % 3 else float(k)) for k in range(6001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    found = preparation.exact_medians(df, ["a", "b", "c", "d"])
    assert found == {"a": np.median([r[0] for r in rows if r[0] is not None]), "b": 2.0, "c": 0.0, "d": np.median([k for k in range(6001) if k % 3 == 0])}
    filled = preparation.imputed(df, found).collect()
    assert all(r.c == 0.0 and r.d == (found["d"] if k % 3 else k) and r.a == (rows[k][0] if k % 7 else found["a"]) for k, r in enumerate(filled))


def test_metrics_match_numpy(spark):
    dice = np.random.default_rng(0)
    y = dice.normal(size=200)
    p = y + dice.normal(scale=0.3, size=200) + 0.2
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    row = lm.regression_metrics(df, "y", "p").first()
    e = y - p
    assert row.rmse == pytest.approx(np.sqrt((e ** 2).mean())) and row.mae == pytest.approx(np.abs(e).mean())
    assert row.r2 == pytest.approx(1 - (e ** 2).mean() / y.var())
    assert row.explained_variance == pytest.approx(1 - e.var() / y.var())
    ranged = scoring.with_interval(df, "y", "p").first()
    assert ranged.prediction_interval_high - ranged.p == pytest.approx(1.96 * e.std())
    histogram = scoring.error_histogram(df, "y", "p").orderBy("bin").collect()
    counts, edges = np.histogram(e, bins=30)
    found = {r.bin: r.rows for r in histogram}
    assert [found.get(i, 0) for i in range(30)] == list(counts)
    assert histogram[0].bin_start == pytest.approx(edges[0])


@pytest.fixture(scope="module")
def prepared(frame):
    rows = preparation.preprocessing(preparation.exact_medians(frame, ["x", "noise"]), {"kind": "big"}).fit(frame).transform(frame)
    return preparation.with_folds(rows, "id").selectExpr("features", "price as label", "fold").cache()


def own_error(model, rows):
    return lm.regression_metrics(model.transform(rows), "label", "prediction").first()["rmse"] ** 2


def test_boosting_prefix_is_its_own_fit(prepared):
    train, held = prepared.where("fold != 0").coalesce(1), prepared.where("fold = 0")
    errors = search.boosting_errors(search.tuned(GBTRegressor(maxIter=12, maxDepth=3, seed=42)).fit(train), held, [5, 12])
    for n in (5, 12):
        own = GBTRegressor(maxIter=n, maxDepth=3, seed=42).fit(train)
        assert errors[(n,)] == pytest.approx(own_error(own, held), rel=1e-9)


def test_cut_forests_score_as_their_trees(prepared):
    train, held = prepared.where("fold != 0").coalesce(1), prepared.where("fold = 0")
    whole = search.tuned(RandomForestRegressor(numTrees=8, maxDepth=9, seed=42)).fit(train)
    errors = search.forest_errors(whole, held, [3, 8], [0, 2, 9])
    assert errors[(8, 9)] == pytest.approx(own_error(whole, held), rel=1e-9)
    trees = [np.array([r.prediction for r in t.transform(held).collect()]) for t in whole.trees[:3]]
    labels = np.array([r.label for r in held.collect()])
    assert errors[(3, 9)] == pytest.approx(((sum(trees) / 3 - labels) ** 2).mean(), rel=1e-9)
    assert errors[(8, 0)] == pytest.approx(labels.var(), rel=0.2)  # roots only
    shallow = RandomForestRegressor(numTrees=8, maxDepth=2, seed=42).fit(train)
    assert shallow.trees[0].depth == 2 and errors[(8, 2)] == pytest.approx(own_error(shallow, held), rel=0.25)


def test_search_gives_every_point_and_agrees_with_own_fits(prepared):
    grid = {"numTrees": [60, 120], "maxDepth": [8, 3], "minInstancesPerNode": [1, 4]}
    estimator = RandomForestRegressor(seed=42)
    with ThreadPoolExecutor(2) as pool:
        found = search.search_forest(pool, estimator, prepared, prepared.count(), grid, 3)()
    assert [p for p, _ in found.errors] == search.points(grid) and found.best == min(found.errors, key=lambda e: e[1])[0]
    for params, error in found.errors:
        own = [own_error(estimator.copy({getattr(estimator, k): v for k, v in params.items()}).fit(prepared.where(f"fold != {k}")),
                         prepared.where(f"fold = {k}")) for k in range(3)]
        assert error == pytest.approx(sum(own) / 3, rel=0.25)  # other random draws, same fit


@pytest.fixture(scope="module")
def fitted(frame):
    train, test = preparation.train_test(frame, "id")
    grids = {lm.FOREST: {"numTrees": [3], "maxDepth": [3, 5]}, lm.BOOSTING: {"maxIter": [3]}}
    found = lm.fit(train, "price", "id", ["x", "noise"], ["kind"], grids=grids)
    for model in found:
        lm.evaluate(model, test, "price")
    return {m.name: m for m in found}, test


def test_every_model_fits(fitted):
    models, _ = fitted
    assert set(models) == {lm.LINEAR, lm.FOREST, lm.BOOSTING}
    assert models[lm.LINEAR].metrics["r2"] > 0.9 and models[lm.FOREST].metrics["r2"] > 0.5
    assert models[lm.FOREST].params["maxDepth"] in (3, 5) and models[lm.LINEAR].params == {"fitIntercept": True}


def test_importance_by_source_column(fitted):
    models, test = fitted
    for model in models.values():
        native = lm.native_importance(model, test)
        assert set(native) == {"x", "noise", "kind"} and sum(native.values()) == pytest.approx(1.0)
    drops = lm.permutation_importance(models[lm.LINEAR], test, "price", "id", repeats=3)
    assert drops["x"] > drops["kind"] > drops["noise"] and abs(drops["noise"]) < 0.05


def test_shuffle_is_a_permutation(frame):
    moved = lm.shuffled(frame.select("id", "noise"), ["noise"], "id", 3, 4).select("id", "noise", "__next.noise").toDF("id", "a", "b")
    pairs = moved.collect()
    assert sorted(r.a for r in pairs) == sorted(r.b for r in pairs) and sum(r.a != r.b for r in pairs) > 390


def test_rows_for_the_marts(spark, fitted, tmp_path):
    models, test = fitted
    table = spark.createDataFrame([(m.name, m.metrics["r2"]) for m in models.values()], "model_name string, r2 double")
    winner = lm.best_of(table).first().model_name
    assert winner == max(models.values(), key=lambda m: m.metrics["r2"]).name
    path = lm.save(models[winner], str(tmp_path / "model"))
    again = lm.load(path).transform(test).select("id", "prediction")
    assert again.exceptAll(models[winner].model.transform(test).select("id", "prediction")).count() == 0
    rows = scoring.model_rows(spark, list(models.values()), winner, datetime(2024, 1, 1), {winner: path})
    assert rows.where("is_active").count() == 1 and rows.where("is_active").first().model_path == path
    active = rows.where("is_active").first().model_id
    results = scoring.result_rows(models[winner].model.transform(test), "price", "id", active, {"x": 0.75, "kind": 0.25}, datetime(2024, 1, 1))
    assert results.count() == test.count()
    found = contracts.violations({"dm_prediction_models": rows, "dm_prediction_results": results})
    assert found.where("violations > 0").count() == 0
    assert results.where("prediction_interval_low > predicted_price or prediction_interval_high < predicted_price").count() == 0
