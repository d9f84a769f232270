"""Schemas of the mart tables, conformance to them, and their declared keys."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.operators.merging import key_violations


PLAIN_TYPES = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(),
               "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _type(text: str) -> T.DataType:
    if text.startswith("decimal"):
        precision, scale = text[len("decimal("):-1].split(",")
        return T.DecimalType(int(precision), int(scale))
    return PLAIN_TYPES[text]


def _fields(text: str) -> T.StructType:
    """Schema from lines ``name type [required]``."""
    fields = []
    for line in text.strip().splitlines():
        name, dtype, *flags = line.split()
        fields.append(T.StructField(name, _type(dtype), "required" not in flags))
    return T.StructType(fields)


@dataclass(frozen=True)
class Contract:
    """A mart table: its schema, primary key, other unique keys and foreign keys (column → table, column)."""

    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)


# The published mart schemas. Measures that can be unknown stay nullable (prices where no sale has
# one, the change against a month that is not there, a unit price without an area, the correlation of a constant column); percentages are wider, so that none is cut.
REGIONAL_TRENDS = Contract("dm_regional_price_trends", _fields("""
region_id int required
region_name string required
period_year int required
period_month int required
avg_price decimal(12,2)
median_price decimal(12,2)
min_price decimal(12,2)
max_price decimal(12,2)
price_momentum decimal(12,2)
transaction_count int required
created_at timestamp
last_updated timestamp"""), ("region_id", "period_year", "period_month"))
NEIGHBORHOODS = Contract("dm_neighborhood_comparison", _fields("""
neighborhood_id int required
neighborhood_name string required
city_name string required
region_id int required
avg_price decimal(12,2)
price_per_sqft decimal(8,2)
price_change_yoy decimal(12,2) required
avg_days_on_market int required
walkability_score decimal(4,1)
school_rating decimal(4,1)
crime_index decimal(4,1)
created_at timestamp
last_updated timestamp"""), ("neighborhood_id",))
SEASONAL = Contract("dm_seasonal_patterns", _fields("""
region_id int required
month int required
price_index decimal(5,2)
transaction_volume_index decimal(5,2) required
days_on_market_index decimal(5,2) required
year_of_analysis int required
created_at timestamp
last_updated timestamp"""), ("region_id", "month", "year_of_analysis"))
FEATURE_IMPORTANCE = Contract("dm_feature_importance", _fields("""
feature_id int required
feature_name string required
feature_category string required
global_importance_score decimal(5,2)
correlation_with_price decimal(4,3)
created_at timestamp
updated_at timestamp
model_version string required"""), ("feature_id",), (("feature_name",),))
REGIONAL_VARIATION = Contract("dm_regional_feature_variation", _fields("""
feature_id int required
region_id int required
importance_score decimal(5,2)
created_at timestamp
relative_importance double"""), ("feature_id", "region_id"), (), {"feature_id": ("dm_feature_importance", "feature_id")})
TEMPORAL_VARIATION = Contract("dm_temporal_feature_variation", _fields("""
feature_id int required
period_year int required
period_quarter int required
importance_score decimal(5,2)
created_at timestamp"""), ("feature_id", "period_year", "period_quarter"), (),
    {"feature_id": ("dm_feature_importance", "feature_id")})
MODELS = Contract("dm_prediction_models", _fields("""
model_id string required
model_name string required
model_version string required
training_date timestamp required
model_params string required
model_metrics string required
is_active boolean
created_at timestamp
model_path string"""), ("model_id",))
PREDICTIONS = Contract("dm_prediction_results", _fields("""
prediction_id string required
property_id bigint required
predicted_price decimal(12,2) required
prediction_interval_low decimal(12,2) required
prediction_interval_high decimal(12,2) required
confidence_score decimal(4,3)
model_id string required
prediction_timestamp timestamp required
feature_contributions string required
created_at timestamp"""), ("prediction_id",), (), {"model_id": ("dm_prediction_models", "model_id")})

CONTRACTS = {c.name: c for c in (
    REGIONAL_TRENDS, NEIGHBORHOODS, SEASONAL, FEATURE_IMPORTANCE, REGIONAL_VARIATION, TEMPORAL_VARIATION, MODELS,
    PREDICTIONS)}


def _conformed(df: DataFrame, f: T.StructField) -> Column:
    if f.name in df.columns:
        value = F.col(f"`{f.name}`")
    elif f.name in ("created_at", "last_updated", "updated_at"):
        value = F.current_timestamp()
    else:
        value = F.lit(None)
    if isinstance(f.dataType, T.DecimalType) and f.name in df.columns:
        # Round on the decimal value first; a value too large for the column raises in the cast.
        value = F.round(value.cast("decimal(30,8)"), f.dataType.scale)
    value = value.cast(f.dataType)
    if not f.nullable:
        value = F.coalesce(value, F.raise_error(F.lit(f"null in required column {f.name}")).cast(f.dataType))
    return value.alias(f.name)


def conform(df: DataFrame, contract: Contract) -> DataFrame:
    """The contract's columns, in order, cast and rounded; a missing optional column becomes null."""
    missing = [f.name for f in contract.schema.fields if not f.nullable and f.name not in df.columns]
    if missing:
        raise ValueError(f"{contract.name} needs {missing}")
    return df.select(*[_conformed(df, f) for f in contract.schema.fields])


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Declared keys of every given mart table checked: (table_name, rule, violations)."""
    reports = []
    for name, df in tables.items():
        c = CONTRACTS[name]
        reports.append(key_violations(
            df, name, [list(c.primary_key), *[list(u) for u in c.unique]],
            [f.name for f in c.schema.fields if not f.nullable and f.name in df.columns],
            [(column, tables[parent], key) for column, (parent, key) in c.references.items() if parent in tables]))
    return reduce(DataFrame.unionByName, reports)
