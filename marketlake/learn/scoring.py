"""Predictions with intervals, model rows, and residual histograms."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.learn.models import Fitted
from marketlake.sources import contracts

INTERVAL_DEVIATIONS = 1.96  # fixed values: width of the interval and stated confidence
CONFIDENCE = 0.8
MODEL_VERSION = "v1.0"


def with_interval(scored: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """Prediction ± 1.96 population deviations of the residual, not below zero. One scalar subquery."""
    spread = scored.agg(F.stddev_pop(F.col(target).cast("double") - F.col(prediction)).alias("s")).scalar()
    margin = spread * F.lit(INTERVAL_DEVIATIONS)
    return scored.withColumns({
        "prediction_interval_low": F.greatest(F.lit(0.0), F.col(prediction) - margin),
        "prediction_interval_high": F.col(prediction) + margin})


def model_rows(spark: SparkSession, models: list[Fitted], active: str, trained: datetime, paths: dict[str, str] | None = None) -> DataFrame:
    """One mart row per fitted model; the named one is active."""
    rows = [(
        f"{m.name.lower().replace(' ', '_')}_{trained:%Y%m%d%H%M%S}", m.name, MODEL_VERSION, trained,
        json.dumps(m.params, sort_keys=True), json.dumps(m.metrics, sort_keys=True), m.name == active, trained,
        (paths or {}).get(m.name)) for m in models]
    return contracts.conform(spark.createDataFrame(rows, contracts.MODELS.schema), contracts.MODELS)


def result_rows(
    scored: DataFrame, target: str, id_column: str, model_id: str, importance: dict[str, float], moment: datetime
) -> DataFrame:
    """Mart rows of the predictions. The id joins day and property, so a repeated run replaces its own rows."""
    ranged = with_interval(scored, target)
    parts = [F.lit(x) for name, value in importance.items() for x in (name, float(value))]
    shares = F.to_json(F.create_map(*parts)) if parts else F.lit("{}")
    stamp = F.lit(moment)
    return contracts.conform(ranged.select(
        F.concat(F.lit(f"pred_{moment:%Y%m%d}_"), F.col(id_column).cast("string")).alias("prediction_id"),
        F.col(id_column).alias("property_id"), F.col("prediction").alias("predicted_price"),
        "prediction_interval_low", "prediction_interval_high", F.lit(CONFIDENCE).alias("confidence_score"),
        F.lit(model_id).alias("model_id"), stamp.alias("prediction_timestamp"), shares.alias("feature_contributions"),
        stamp.alias("created_at")), contracts.PREDICTIONS)


def error_histogram(df: DataFrame, label: str, prediction: str, bins: int = 30) -> DataFrame:
    """Rows per equal-width bin of the residual; the last bin includes its upper edge."""
    errors = df.select((F.col(label).cast("double") - F.col(prediction)).alias("e"))
    ends = errors.agg(F.struct(F.min("e").alias("low"), F.max("e").alias("high")).alias("x")).scalar()
    low, width = ends["low"], (ends["high"] - ends["low"]) / F.lit(float(bins))
    slot = F.when(width > 0, F.least(F.floor(F.try_divide(F.col("e") - low, width)), F.lit(bins - 1))).otherwise(F.lit(0))
    return errors.where(F.col("e").isNotNull()).select(slot.cast("int").alias("bin"), low.alias("l"), width.alias("w")).groupBy(
        "bin", "l", "w").agg(F.count(F.lit(1)).alias("rows")).select(
        "bin", (F.col("l") + F.col("bin") * F.col("w")).alias("bin_start"),
        (F.col("l") + (F.col("bin") + 1) * F.col("w")).alias("bin_end"), "rows")
