"""The registered model queries run the published job on a few hundred real rows: whole grids, every column permuted, one training."""

from __future__ import annotations

import json
import shutil

import pytest

from marketlake.learn import models as lm
from marketlake.learn import store
from marketlake.queries import learning
from marketlake.session import build_session, shared_dir

TABLES = ("region", "nation", "customer", "orders", "lineitem", "part")
QUERIES = ("ml_grid", "ml_forest", "ml_boosting", "ml_linear", "ml_importance", "ml_select", "mart_models", "mart_predictions", "serving_models",
           "serving_active_model", "serving_predictions", "serving_prediction_intervals", "serving_contributions")


@pytest.fixture(scope="module")
def few_rows(spark, folder, tmp_path_factory):
    """The test tables with a fifth of the orders."""
    target = tmp_path_factory.mktemp("few")
    for t in TABLES:
        rows = spark.read.parquet(f"{folder}/{t}.parquet")
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(t)
        (rows.where(f"{key} % 5 = 0") if key else rows).coalesce(1).write.parquet(str(target / f"{t}.parquet"))
    return str(target)


def test_one_training_serves_all_queries(spark, few_rows, monkeypatch):
    fits, fit = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a, **k: fits.append(a[5]) or fit(*a, **k))
    rows = {name: learning.family.queries[name](spark, few_rows).collect() for name in QUERIES}
    assert sorted(n for names in fits for n in names) == sorted([lm.FOREST, lm.BOOSTING, lm.LINEAR])  # each model once
    grid = [(r.model_name, tuple(sorted(json.loads(r.params).items()))) for r in rows["ml_grid"]]
    want = [(n, tuple(sorted(p.items()))) for n, g in ((lm.FOREST, lm.FOREST_GRID), (lm.BOOSTING, lm.BOOSTING_GRID)) for p in lm.search.points(g)]
    assert grid == want and len(want) == 20 and all(r.mean_squared_error > 0 for r in rows["ml_grid"])
    for name in (lm.FOREST, lm.BOOSTING):
        mine = [r for r in rows["ml_grid"] if r.model_name == name]
        assert [r.chosen for r in mine].index(True) == min(range(len(mine)), key=lambda k: mine[k].mean_squared_error)
    permuted = [r.feature_name for r in rows["ml_importance"] if r.kind == "permutation"]
    assert len(set(permuted)) == len(permuted) == 16 and len(rows["ml_forest"]) == len(rows["ml_linear"]) > 30
    assert sum(r.is_active for r in rows["mart_models"]) == 1 and len(rows["mart_predictions"]) == len(rows["ml_forest"])
    assert all(rows[n] for n in QUERIES)


def test_changed_input_is_fitted_anew(spark, few_rows, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "BOOSTING_GRID", {"maxIter": [2]})
    built = []
    monkeypatch.setattr(learning.store, "fitted_once", lambda spark, root, names, build: built.append(root) or [])
    copy = tmp_path / "copy"
    shutil.copytree(few_rows, copy)
    learning.trained(spark, str(copy), [lm.LINEAR])
    learning.trained(spark, str(copy), [lm.LINEAR])
    spark.read.parquet(f"{few_rows}/orders.parquet").limit(300).coalesce(1).write.mode("overwrite").parquet(str(copy / "orders.parquet"))
    learning.trained(spark, str(copy), [lm.LINEAR])
    assert built[0] == built[1] != built[2] and built[0].startswith(shared_dir(spark))


def test_another_session_loads(spark, few_rows):
    assert build_session  # sessions share the folder of spark.checkpoint.dir, not their application's
    fitted, test = learning.trained(spark, few_rows, [lm.LINEAR])
    other = spark.newSession()
    root = next(iter(store_roots(other)))
    loaded = store.get(other, root, lm.LINEAR)
    assert loaded.metrics == pytest.approx(fitted[0].metrics) and loaded.numeric == fitted[0].numeric
    assert loaded.model.transform(test).agg({"prediction": "sum"}).first() == fitted[0].model.transform(test).agg({"prediction": "sum"}).first()


def store_roots(spark):
    fs, path = store.file_system(spark, f"{shared_dir(spark)}/models")
    return [s.getPath().toString() for s in fs.listStatus(path) if store.exists(spark, store.place(s.getPath().toString(), lm.LINEAR))]
