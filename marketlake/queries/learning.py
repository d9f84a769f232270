"""Splits, model fits, metrics, importance, and the model and prediction marts."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from marketlake.functions.rules import pseudo_coordinate
from marketlake.learn import models as lm
from marketlake.learn import preparation, scoring, store
from marketlake.operators.quality import column_stats
from marketlake.plans import analytics, serving
from marketlake.queries.base import LISTINGS, Family, r, rounded
from marketlake.queries.quality import labelled_documents
from marketlake.queries.stored import input_state, stored
from marketlake.session import shared_dir
from marketlake.sources.orders_market import listings_view

family = Family()
TARGET, ID = "target_price", "property_id"
MOMENT = datetime(2024, 1, 1)  # fixed run time, so a repeated run gives the same rows


def model_source(spark, folder):
    """Model rows without the id's and the target's derivatives."""
    name = F.col("neighborhood")
    rows = listings_view(spark, folder).select(
        ID, F.col("price").alias(TARGET), "property_type", "condition", "transaction_date", "total_rooms", "bathrooms",
        "bedrooms", "roof_type", F.col("pool").alias("has_pool"), "region",
        pseudo_coordinate(name, 8, -93.62).alias("longitude"), pseudo_coordinate(name, 9, 42.03).alias("latitude"))
    return analytics.prediction_features(rows).drop("transaction_date")


def trained(spark, folder, names):
    """(fitted models with test metrics, test rows), from the stored feature rows.

    Models are kept in the shared folder under the state of the input and the search: they are fitted by whichever query needs them
    first, also of an earlier session, and fitted anew when a table of the folder changes.
    """
    rows = stored(spark, folder, "model_rows", model_source)
    train, test = preparation.train_test(rows, ID)
    numeric, categorical = preparation.feature_columns(rows, TARGET, ID)

    def build(missing):
        fitted = lm.fit(train, TARGET, ID, numeric, categorical, missing)
        for model in fitted:
            lm.evaluate(model, test, TARGET)
        return fitted

    key = repr((folder, input_state(spark, folder), numeric, categorical, lm.FOREST_GRID, lm.BOOSTING_GRID))
    root = f"{shared_dir(spark)}/models/{hashlib.sha256(key.encode()).hexdigest()[:16]}"
    return store.fitted_once(spark, root, names, build), test


SCORED = LISTINGS + """, scored as (
  select property_id, price, 50000.0 + 1500.0 * total_rooms + 10000.0 * bedrooms as prediction from listings)"""


def fixed_score(spark, folder):
    """A fixed linear score as the prediction, so that SQL can repeat it."""
    return listings_view(spark, folder).select(
        ID, "price", (F.lit(50000.0) + F.col("total_rooms") * 1500.0 + F.col("bedrooms") * 10000.0).alias("prediction"))


@family.add("ml_metrics", f"""
with {SCORED}, e as (select price, price - prediction as e from scored)
select {r('sqrt(avg(e * e))', 4)} as rmse, {r('avg(abs(e))', 4)} as mae, {r('1 - avg(e * e) / var_pop(price)', 6)} as r2,
  {r('1 - var_pop(e) / var_pop(price)', 6)} as explained_variance, {r('stddev_pop(e)', 4)} as error_deviation from e""")
def ml_metrics(spark, folder):
    scored = fixed_score(spark, folder)
    spread = scored.agg(F.stddev_pop(F.col("price") - F.col("prediction")).alias("s")).scalar()
    table = lm.regression_metrics(scored, "price", "prediction").withColumn("error_deviation", spread)
    return rounded(table, {"rmse": 4, "mae": 4, "r2": 6, "explained_variance": 6, "error_deviation": 4})


@family.add("ml_interval", f"""
with {SCORED}, s as (select stddev_pop(price - prediction) as s from scored)
select property_id, prediction, {r('greatest(0, prediction - 1.96 * s)', 4)} as prediction_interval_low,
  {r('prediction + 1.96 * s', 4)} as prediction_interval_high from scored, s""")
def ml_interval(spark, folder):
    ranged = scoring.with_interval(fixed_score(spark, folder), "price").drop("price")
    return rounded(ranged, {"prediction_interval_low": 4, "prediction_interval_high": 4})


@family.add("ml_error_histogram", f"""
with {SCORED}, e as (select price - prediction as e from scored),
x as (select min(e) as l, (max(e) - min(e)) / 30.0 as w from e)
select cast(least(floor((e - l) / w), 29) as int) as bin, {r('any_value(l) + least(floor((e - l) / w), 29) * any_value(w)', 4)} as bin_start,
  {r('any_value(l) + (least(floor((e - l) / w), 29) + 1) * any_value(w)', 4)} as bin_end, count(*) as rows
from e, x group by least(floor((e - l) / w), 29)""")
def ml_error_histogram(spark, folder):
    return rounded(scoring.error_histogram(fixed_score(spark, folder), "price", "prediction"), {"bin_start": 4, "bin_end": 4})


@family.add("ml_linear_one_feature", f"""
with {LISTINGS} select {r('regr_slope(price, total_rooms)', 3)} as slope, {r('regr_intercept(price, total_rooms)', 2)} as intercept,
  {r('regr_r2(price, total_rooms)', 5)} as r2 from listings""")
def ml_linear_one_feature(spark, folder):
    """Least squares on one feature, where SQL has the closed form."""
    rows = VectorAssembler(inputCols=["total_rooms"], outputCol="features").transform(
        listings_view(spark, folder).select("price", "total_rooms"))
    model = LinearRegression(labelCol="price", regParam=0.0, solver="normal").fit(rows)
    quality = lm.regression_metrics(model.transform(rows), "price", "prediction")
    return rounded(quality.select(
        F.lit(float(model.coefficients[0])).alias("slope"), F.lit(float(model.intercept)).alias("intercept"), "r2"),
        {"slope": 3, "intercept": 2, "r2": 5})


@family.add("ml_split")
def ml_split(spark, folder):
    side = F.when(preparation.split_share(ID) < 80, "train").otherwise("test")
    return listings_view(spark, folder).groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("rows"))


@family.add("ml_prepared")
def ml_prepared(spark, folder):
    """Imputed, standardised and one-hot rows: the spread of every slot of the feature vector."""
    rows = stored(spark, folder, "model_rows", model_source)
    numeric, categorical = preparation.feature_columns(rows, TARGET, ID)
    modes = preparation.most_frequent(rows, categorical)
    prepared = preparation.preprocessing(preparation.exact_medians(rows, numeric), modes).fit(rows).transform(rows)
    slots = prepared.select(F.posexplode(vector_to_array(preparation.FEATURES)).alias("slot", "value"))
    return slots.groupBy("slot").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("stddev"))


IMPUTED = ("n_chars", "quality", "toxic")


@family.add("ml_imputed", f"""
with labelled as (select d.*, quality, toxic from documents d left join labels using (doc_id))
""" + " union all ".join(f"""select * from (
  select '{c}' as column_name, count(*) - count({c}) as missing, any_value(m) as median, {r(f'avg(coalesce(cast({c} as double), m))', 6)} as mean,
    {r(f'stddev_samp(coalesce(cast({c} as double), m))', 6)} as stddev from labelled, (select quantile_cont({c}, 0.5) as m from labelled) q)"""
    for c in IMPUTED))
def ml_imputed(spark, folder):
    """Exact medians for the missing values: what they are, and mean and deviation of the filled columns."""
    rows = labelled_documents(spark, folder).select("doc_id", *IMPUTED)
    medians = preparation.exact_medians(rows, list(IMPUTED))
    missing = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in IMPUTED]).unpivot([], list(IMPUTED), "column_name", "missing")
    filled = column_stats(preparation.imputed(rows, medians), list(IMPUTED)).select("column_name", "mean", "stddev")
    known = spark.createDataFrame(list(medians.items()), "column_name string, median double")
    return rounded(missing.join(known, "column_name").join(filled, "column_name"), {"mean": 6, "stddev": 6})


def _predictions(name: str, model_name: str) -> None:
    @family.add(name)
    def query(spark, folder):
        fitted, test = trained(spark, folder, [model_name])
        scored = scoring.with_interval(fitted[0].model.transform(test), TARGET)
        return scored.select(ID, TARGET, "prediction", "prediction_interval_low", "prediction_interval_high")


_predictions("ml_linear", lm.LINEAR)
_predictions("ml_forest", lm.FOREST)
_predictions("ml_boosting", lm.BOOSTING)


def _shares(spark, shares: dict[str, float]):
    return spark.createDataFrame(list(shares.items()), "feature_name string, importance double")


@family.add("ml_grid")
def ml_grid(spark, folder):
    """Every point of the published grids with its cross-validated error; the chosen one is marked."""
    fitted, _ = trained(spark, folder, [lm.FOREST, lm.BOOSTING])
    points = [(m.name, json.dumps(p, sort_keys=True), error, p == m.params) for m in fitted for p, error in m.searched]
    return spark.createDataFrame(points, "model_name string, params string, mean_squared_error double, chosen boolean")


@family.add("ml_importance")
def ml_importance(spark, folder):
    fitted, test = trained(spark, folder, [lm.FOREST])
    native = _shares(spark, lm.native_importance(fitted[0], test)).withColumn("kind", F.lit("native"))
    permuted = lm.permutation_importance(fitted[0], test, TARGET, ID)
    return native.unionByName(_shares(spark, permuted).withColumn("kind", F.lit("permutation")))


def model_marts(spark, folder, names):
    """(model rows, best fitted model, test rows)."""
    fitted, test = trained(spark, folder, names)
    table = spark.createDataFrame(
        [(f.name, *[f.metrics[m] for m in lm.METRICS]) for f in fitted],
        "model_name string, " + ", ".join(f"{m} double" for m in lm.METRICS))
    winner = lm.best_of(table).first()["model_name"]
    best = next(f for f in fitted if f.name == winner)
    return scoring.model_rows(spark, fitted, winner, MOMENT), best, test, table


def prediction_mart(spark, folder, names=(lm.LINEAR, lm.FOREST, lm.BOOSTING)):
    models, best, test, _ = model_marts(spark, folder, list(names))
    model_id = models.where("is_active").first()["model_id"]
    results = scoring.result_rows(
        best.model.transform(test), TARGET, ID, model_id, lm.native_importance(best, test), MOMENT)
    return results, models


def stored_models(spark, folder):
    return stored(spark, folder, "models", lambda spark, folder: model_marts(spark, folder, [lm.LINEAR, lm.FOREST, lm.BOOSTING])[0])


def stored_predictions(spark, folder):
    return stored(spark, folder, "predictions", lambda spark, folder: prediction_mart(spark, folder)[0])


@family.add("ml_select")
def ml_select(spark, folder):
    return lm.best_of(model_marts(spark, folder, [lm.LINEAR, lm.FOREST, lm.BOOSTING])[3])


@family.add("mart_models")
def mart_models(spark, folder):
    return model_marts(spark, folder, [lm.LINEAR, lm.FOREST, lm.BOOSTING])[0]


@family.add("mart_predictions")
def mart_predictions(spark, folder):
    """Predictions of the best of the three models."""
    return stored_predictions(spark, folder)


@family.add("serving_models")
def serving_models(spark, folder):
    return serving.model_list(stored_models(spark, folder))


@family.add("serving_active_model")
def serving_active_model(spark, folder):
    return serving.active_model(stored_models(spark, folder))


@family.add("serving_predictions")
def serving_predictions(spark, folder):
    """Predictions of the active model, listed with its row of the model mart."""
    return serving.predictions(stored_predictions(spark, folder), stored_models(spark, folder))


@family.add("serving_prediction_intervals")
def serving_prediction_intervals(spark, folder):
    return serving.prediction_intervals(stored_predictions(spark, folder))


@family.add("serving_contributions")
def serving_contributions(spark, folder):
    return serving.contributions(stored_predictions(spark, folder))


def fixed_results(spark, folder):
    """Prediction rows of the fixed score, so that SQL can repeat what is served from them."""
    return scoring.result_rows(fixed_score(spark, folder), "price", ID, "fixed", {"total_rooms": 0.75, "bedrooms": 0.25}, MOMENT)


RESULTS = f"""{SCORED}, s as (select stddev_pop(price - prediction) as s from scored),
results as (
  select 'pred_20240101_' || property_id as prediction_id, property_id, prediction, greatest(0, prediction - 1.96 * s) as low,
    prediction + 1.96 * s as high from scored, s)"""


@family.add("serving_intervals_of_fixed_score", f"""
with {RESULTS} select prediction_id, property_id, {r('prediction', 2)} as predicted_price, {r('low', 2)} as prediction_interval_low,
  {r('high', 2)} as prediction_interval_high, 80.0 as confidence_pct, {r('round(high, 2) - round(low, 2)', 2)} as interval_width
from results order by prediction desc, prediction_id limit 10""")
def serving_intervals_of_fixed_score(spark, folder):
    """The highest predictions with interval width and confidence."""
    return serving.prediction_intervals(fixed_results(spark, folder))


@family.add("serving_contributions_of_fixed_score", f"""
with {RESULTS} select prediction_id, feature, contribution from results, (values ('total_rooms', 0.75), ('bedrooms', 0.25)) f(feature, contribution)""")
def serving_contributions_of_fixed_score(spark, folder):
    """One row for each prediction and feature, read out of the JSON text of the mart."""
    return serving.contributions(fixed_results(spark, folder))
