"""Guarded arithmetic: ratios, percentages, correlations and averages that never divide by zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null when the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_numerator(numerator: Column, denominator: Column) -> Column:
    """Quotient for a positive denominator, else the numerator itself."""
    return F.when(denominator > 0, ratio(numerator, denominator)).otherwise(numerator.cast("double"))


def steady_round(column: Column, digits: int) -> Column:
    """Round half up on the decimal value. The last bits of a floating-point sum depend on the order in which
    partitions arrive; dropping them first keeps the result of a tie the same on every run."""
    return F.round(column.cast("decimal(30,8)"), digits).cast("double")


def steady_mean(column: Column | str) -> Column:
    """Aggregate mean of doubles as an exact decimal sum and one division: the same on every run."""
    value = F.col(column) if isinstance(column, str) else column
    return F.try_divide(F.sum(value.cast("decimal(30,8)")).cast("double"), F.count(value).cast("double"))


def pct_change(current: Column, previous: Column, digits: int = 2) -> Column:
    """Percent change, null unless the previous value is positive."""
    change = ratio(current - previous, previous) * F.lit(100).cast("double")
    return F.when(previous > 0, steady_round(change, digits))


def index_to_mean(value: Column, mean: Column, digits: int = 4, default: float = 1.0) -> Column:
    """value / mean, or the default when the mean is not positive."""
    return F.when(mean > 0, steady_round(ratio(value, mean), digits)).otherwise(F.lit(default))


def average(column: Column, scale: int | None = None) -> Column:
    """Aggregate average; with ``scale`` an exact decimal sum and one division."""
    if scale is None:
        return F.avg(column)
    total = F.sum(column.cast(f"decimal(18,{scale})")).cast("double")
    return F.try_divide(total, F.count(column).cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate Pearson correlation; null (not an error) for a constant column."""
    x, y = x.cast("double"), y.cast("double")
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def planar_km(lon: Column, lat: Column, centre_lon: float, centre_lat: float, km_per_degree: float = 111.0) -> Column:
    """Straight-line distance on the degree grid."""
    dx, dy = lon - F.lit(centre_lon), lat - F.lit(centre_lat)
    return F.sqrt(dx * dx + dy * dy) * F.lit(km_per_degree)


def haversine_km(lon: Column, lat: Column, centre_lon: float, centre_lat: float) -> Column:
    """Great-circle distance."""
    a = (F.pow(F.sin(F.radians(lat - F.lit(centre_lat)) / 2), 2)
         + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(centre_lat)))
         * F.pow(F.sin(F.radians(lon - F.lit(centre_lon)) / 2), 2))
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a))
