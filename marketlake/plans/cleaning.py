"""From landed rows to cleaned, scored rows. Each step is one projection; absent columns are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.nulls import numeric_columns, or_default, text_or_default
from marketlake.functions.text import drop_spaces, squash_spaces
from marketlake.operators.quality import flag_outliers, quality_score

# Columns of the published listings table and their defaults.
NUMERIC = ("price", "surface", "rooms", "bedrooms", "bathrooms", "price_per_sqm", "longitude", "latitude")
BOOLEAN = ("has_garden", "has_pool", "has_garage", "has_terrace", "has_parking")
DATES = ("listing_date", "transaction_date")
TEXT = ("address", "city", "postal_code", "description", "property_type")
NUMERIC_DEFAULTS = {"price": 0.0, "surface": 0.0, "rooms": 0, "bedrooms": 0, "bathrooms": 0}
BOOLEAN_DEFAULTS = dict.fromkeys(BOOLEAN, False)
TEXT_DEFAULTS = {"address": "Adresse inconnue", "city": "Ville inconnue", "postal_code": "00000",
                 "description": "Pas de description", "property_type": "inconnu"}
OUTLIER_COLUMNS = ("price", "surface", "rooms", "bedrooms", "bathrooms")
KEY_COLUMNS = ("id", "price", "surface", "address", "city", "postal_code", "property_type", "rooms")


def _with(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """Replace the columns that exist, in one projection."""
    return df.withColumns({name: column for name, column in changed.items() if name in df.columns})


def cast_columns(df: DataFrame, numeric=NUMERIC, boolean=BOOLEAN, date=DATES) -> DataFrame:
    """Numbers, flags and dates from text; what cannot be read becomes null."""
    wanted = {**dict.fromkeys(numeric, "double"), **dict.fromkeys(boolean, "boolean"), **dict.fromkeys(date, "date")}
    return _with(df, {c: F.col(f"`{c}`").try_cast(t) for c, t in wanted.items()})


def normalise_text(df: DataFrame, squash=TEXT, strip=("postal_code",), lower=("property_type",)) -> DataFrame:
    steps: dict[str, Column] = {}
    for names, step in ((squash, squash_spaces), (strip, drop_spaces), (lower, F.lower)):
        for name in names:
            steps[name] = step(steps.get(name, F.col(f"`{name}`")))
    return _with(df, steps)


def fill_defaults(df: DataFrame, numeric: dict | None = None, boolean: dict | None = None, text: dict | None = None) -> DataFrame:
    """Typed defaults for nulls; text columns also for the empty string. With no argument, the listing defaults."""
    if numeric is None and boolean is None and text is None:
        numeric, boolean, text = NUMERIC_DEFAULTS, BOOLEAN_DEFAULTS, TEXT_DEFAULTS
    filled = {c: or_default(F.col(f"`{c}`"), v) for c, v in {**(numeric or {}), **(boolean or {})}.items()}
    filled |= {c: text_or_default(F.col(f"`{c}`"), v) for c, v in (text or {}).items()}
    return _with(df, filled)


def fill_zero(df: DataFrame) -> DataFrame:
    """Nulls of every numeric column become 0; text and flags stay."""
    return df.na.fill(0, numeric_columns(df))


def with_source(df: DataFrame, source_system: str) -> DataFrame:
    """Processing time, and the source system unless the rows already name one."""
    added = {"processing_timestamp": F.current_timestamp()}
    if "source_system" not in df.columns:
        added["source_system"] = F.lit(source_system)
    return df.withColumns(added)


def clean(
    df: DataFrame,
    source_system: str,
    outlier_columns=OUTLIER_COLUMNS,
    key_columns=KEY_COLUMNS,
    stats: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Cast, tidy, fill, flag, score and stamp. ``stats`` are stored limits for rows of a stream."""
    ready = fill_defaults(normalise_text(cast_columns(df)))
    numeric = [c for c in outlier_columns if c in ready.columns]
    flagged = flag_outliers(ready, numeric, stats=stats) if numeric else ready
    return with_source(quality_score(flagged, list(key_columns)), source_system)
