"""Column roles: which column of a table plays which part in the analysis."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    """Names of the columns the operators work on.

    ``money_scale`` is the number of decimals of the price column. With it, averages are an exact
    decimal sum divided once, so they do not depend on how rows were partitioned. ``None`` means a
    plain floating-point average.
    """

    id: str = "property_id"
    price: str = "price"
    date: str = "transaction_date"
    listing_date: str = "listing_date"
    region: str = "region"
    city: str = "city"
    neighborhood: str = "neighborhood"
    kind: str = "property_type"
    unit_price: str | None = None
    money_scale: int | None = 2
