"""A full run: land the sources, clean them, build dimensions, analytic tables and marts, each layer on disk.

Every step reads what the step before wrote, so a lost executor or a failed step repeats one layer only, and
running a day twice replaces that day. Errors are raised, never swallowed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.learn import models, preparation, scoring, store
from marketlake.operators.merging import one_of_each, upsert
from marketlake.plans import analytics, dimensions, marts
from marketlake.plans.cleaning import clean
from marketlake.roles import Roles
from marketlake.session import shared_dir
from marketlake.sources import contracts
from marketlake.sources.files import exists, file_system, read_day, read_latest, upsert_table, with_run_date, write_clustered, write_reconciled, write_table

SOURCE_RANK = {"static": 0, "streaming": 1}
#: Training rows below which no model is fitted: three folds and a test side need some rows each.
LEAST_TRAINING_ROWS = 60
TARGET, ID = "target_price", "property_id"
#: What dashboards filter marts by: rows are kept in ranges of these.
CLUSTERED = ("region_name", "period_year", "period_month")
UNIT_ROLES = Roles(unit_price="price_per_sqft")


@dataclass(frozen=True)
class Layout:
    """Folders of the layers below one root."""

    root: str

    def path(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"


def land(df: DataFrame, source: str, layout: Layout, run_date: date) -> None:
    """Rows as they came, with processing time and source, in the run day's directory."""
    stamped = df.withColumns({"processing_timestamp": F.current_timestamp(), "source_type": F.lit(source)})
    rows, complete = write_reconciled(with_run_date(stamped, run_date), layout.path("raw", source), run_date)
    if not complete:
        raise RuntimeError(f"raw/{source}: {rows} rows were sent, but another number landed")


def _day(spark: SparkSession, layout: Layout, layer: str, table: str, run_date: date) -> DataFrame:
    found = read_day(spark, layout.path(layer, table), run_date)
    if found is None:
        raise FileNotFoundError(f"{layer}/{table} has no rows for {run_date}")
    return found.drop("year", "month", "day")


def refine(spark: SparkSession, source: str, layout: Layout, run_date: date, **columns) -> None:
    rows = _day(spark, layout, "raw", source, run_date)
    write_table(with_run_date(clean(rows, source, **columns), run_date), layout.path("bronze", source))


def build_dimensions(spark: SparkSession, sources: list[str], layout: Layout, run_date: date, id_column: str = "Id") -> None:
    """Union of the cleaned sources, one row per id (batch before stream; rows without an id all stay), as four dimension tables."""
    rows = [_day(spark, layout, "bronze", s, run_date).withColumn("__rank", F.lit(SOURCE_RANK.get(s, 9))) for s in sources]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    single = one_of_each(united, [id_column], ["__rank"]).drop("__rank")
    for name, table in dimensions.dimension_tables(single).items():
        write_table(with_run_date(table, run_date), layout.path("silver", name))


def build_analytics(spark: SparkSession, layout: Layout, run_date: date, roles: Roles = UNIT_ROLES) -> None:
    names = ("property_details", "location_details", "building_features", "sale_history")
    tables = analytics.analytic_tables({n: _day(spark, layout, "silver", n, run_date) for n in names}, roles)
    for name, table in tables.items():
        write_table(analytics.stamped(table, "property_details,location_details", run_date), layout.path("gold", name))


def build_marts(spark: SparkSession, layout: Layout, run_date: date) -> None:
    gold = {n: _day(spark, layout, "gold", n, run_date) for n in (
        "price_trends", "feature_importance", "seasonal_variations", "market_indicators")}
    properties, locations, buildings = (
        _day(spark, layout, "silver", n, run_date) for n in ("property_details", "location_details", "building_features"))
    sales = analytics.sales_table(properties, locations)
    regions = marts.region_dictionary(locations)
    features = marts.feature_importance(gold["feature_importance"])
    rows = analytics.importance_rows(properties, buildings, locations).join(
        sales.select("property_id", "region", "transaction_date"), "property_id")
    numeric = list(analytics.NUMERIC_FEATURES)
    tables = {
        "dm_regional_price_trends": marts.regional_trends(gold["price_trends"], regions),
        "dm_neighborhood_comparison": marts.neighborhood_comparison(
            gold["price_trends"], gold["market_indicators"], locations, regions),
        "dm_seasonal_patterns": marts.seasonal_patterns(
            gold["seasonal_variations"], regions, run_date.year, marts.days_by_calendar_month(sales)),
        "dm_feature_importance": features,
        "dm_regional_feature_variation": marts.regional_variation(rows, numeric, features, regions),
        "dm_temporal_feature_variation": marts.temporal_variation(rows, numeric, features),
    }
    for name, table in tables.items():
        place, order = layout.path("marts", name), [c for c in CLUSTERED if c in table.columns]
        if order:
            write_clustered(table, place, order)
        else:
            write_table(table, place, parts=())


def build_models(spark: SparkSession, layout: Layout, run_date: date, grids: dict[str, dict] | None = None) -> None:
    """Fit the price models on the day's feature rows, keep them, and merge both model marts by key.

    A day's models are fitted once: a second run loads them and changes nothing. The best model of the day becomes the active one and
    all earlier rows lose that mark. Predictions replace those of the same day and property. With fewer than ``LEAST_TRAINING_ROWS``
    training rows nothing is fitted and both marts stay as they are (empty at first).
    """
    rows = _day(spark, layout, "gold", "price_prediction_features", run_date).drop("generated_at", "source_table")
    rows = rows.where(F.col(TARGET).isNotNull() & F.col(ID).isNotNull())
    train, test = preparation.train_test(rows, ID)
    numeric, categorical = preparation.feature_columns(rows, TARGET, ID)
    moment, root = datetime(run_date.year, run_date.month, run_date.day), layout.path("models", f"{run_date:%Y%m%d}")
    known, results = contracts.conform(spark.createDataFrame([], contracts.MODELS.schema), contracts.MODELS), None
    if train.limit(LEAST_TRAINING_ROWS).count() == LEAST_TRAINING_ROWS and test.take(1):
        def build(missing: list[str]) -> list[models.Fitted]:
            fitted = models.fit(train, TARGET, ID, numeric, categorical, missing, grids)
            for model in fitted:
                models.evaluate(model, test, TARGET)
            return fitted

        fitted = store.fitted_once(spark, root, [models.LINEAR, models.FOREST, models.BOOSTING], build)
        best = max(sorted(fitted, key=lambda m: m.name), key=lambda m: (m.metrics["r2"] is not None, m.metrics["r2"] or 0.0))
        known = scoring.model_rows(spark, fitted, best.name, moment, {m.name: f"{store.place(root, m.name)}/pipeline" for m in fitted})
        model_id = known.where("is_active").first()["model_id"]
        results = scoring.result_rows(best.model.transform(test), TARGET, ID, model_id, models.native_importance(best, test), moment)
    _merge_models(spark, layout.path("marts", "dm_prediction_models"), known)
    place = layout.path("marts", "dm_prediction_results")
    if results is not None:
        upsert_table(spark, place, results.withColumn("day", F.to_date("prediction_timestamp")), ["prediction_id", "day"], ["day"])
    elif not exists(spark, place):
        write_table(spark.createDataFrame([], contracts.PREDICTIONS.schema).withColumn("day", F.to_date("prediction_timestamp")), place, parts=())


def _merge_models(spark: SparkSession, path: str, batch: DataFrame) -> None:
    """Upsert the model mart; rows that are not in the batch stop being active as soon as it has an active one."""
    if not exists(spark, path):
        write_table(batch, path, parts=())
        return
    if not batch.take(1):
        return
    staging = f"{shared_dir(spark)}/staging/{uuid.uuid4().hex}"
    current = spark.read.parquet(path).withColumn("is_active", F.lit(False))
    write_table(upsert(current, batch, ["model_id"]), staging, parts=())
    write_table(spark.read.parquet(staging), path, parts=())
    fs, target = file_system(spark, staging)
    fs.delete(target, True)


def mart_tables(spark: SparkSession, layout: Layout) -> dict[str, DataFrame]:
    names = ("dm_regional_price_trends", "dm_neighborhood_comparison", "dm_seasonal_patterns", "dm_feature_importance",
             "dm_regional_feature_variation", "dm_temporal_feature_variation", "dm_prediction_models", "dm_prediction_results")
    return {n: spark.read.parquet(layout.path("marts", n)).select(contracts.CONTRACTS[n].schema.names) for n in names}


def latest(spark: SparkSession, layout: Layout, layer: str, table: str) -> DataFrame | None:
    """Newest day of a stored table, for jobs that need not run on the same day."""
    return read_latest(spark, layout.path(layer, table))


def run(
        spark: SparkSession, sources: dict[str, DataFrame], root: str, run_date: date, roles: Roles = UNIT_ROLES,
        grids: dict[str, dict] | None = None, **columns) -> Layout:
    """All layers for one day. ``columns`` are the outlier and key columns of the cleaning step, ``grids`` replace searched grids by name."""
    layout = Layout(root)
    for name, rows in sources.items():
        land(rows, name, layout, run_date)
        refine(spark, name, layout, run_date, **columns)
    build_dimensions(spark, list(sources), layout, run_date)
    build_analytics(spark, layout, run_date, roles)
    build_marts(spark, layout, run_date)
    build_models(spark, layout, run_date, grids)
    return layout
