"""Named views over the joined sales, for SQL users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.functions.dates import quarter_label
from marketlake.functions.numbers import average
from marketlake.roles import Roles


def publish_views(listings: DataFrame, roles: Roles = Roles()) -> list[str]:
    """Register ``dw_property_sales``, ``dw_property_features``, ``dw_location_metrics`` and ``dw_time_metrics``.

    Views are lazy: a query reads only the columns and rows it asks for.
    """
    dated = listings.withColumns({
        "sale_year": F.year(roles.date), "sale_month": F.month(roles.date), "sale_quarter": quarter_label(F.col(roles.date))})
    sale_columns = {roles.id, roles.price, roles.date, roles.listing_date, roles.region, roles.city, roles.neighborhood,
                    roles.kind, "condition", "unit_price", "sale_year", "sale_month", "sale_quarter"}
    measures = [F.count(roles.id).alias("properties_sold"), average(F.col(roles.price), roles.money_scale).alias("avg_price"),
                F.min(roles.price).alias("min_price"), F.max(roles.price).alias("max_price")]
    views = {
        "dw_property_sales": dated.select(*[c for c in dated.columns if c in sale_columns]),
        "dw_property_features": dated.select(
            roles.id, *[c for c in dated.columns if c not in sale_columns]),
        "dw_location_metrics": dated.groupBy(roles.region, roles.city, roles.neighborhood).agg(*measures),
        "dw_time_metrics": dated.groupBy("sale_year", "sale_quarter", "sale_month").agg(*measures),
    }
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    return list(views)
