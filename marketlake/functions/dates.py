"""Calendar parts, month names, periods and day counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and seasons of the published tables.
MONTH_NAMES = ("Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août", "Septembre",
               "Octobre", "Novembre", "Décembre")
SEASONS = {"Printemps": (3, 4, 5), "Été": (6, 7, 8), "Automne": (9, 10, 11)}
SEASON_DEFAULT = "Hiver"


def mid_month(year: Column, month: Column) -> Column:
    """The 15th of a month; null when a part is missing or is not a valid month."""
    valid = month.between(1, 12)
    return F.when(valid, F.make_date(year, F.when(valid, month), F.lit(15)))


def first_of_month(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def one_month_before(date: Column) -> Column:
    return F.add_months(date, -1)


def quarter_label(date: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(date).cast("string"))


def year_quarter_label(year: Column, quarter: Column) -> Column:
    """``2023-Q1``."""
    return F.concat(year.cast("string"), F.lit("-Q"), quarter.cast("string"))


def parse_year_quarter(label: Column) -> tuple[Column, Column]:
    """Year and quarter of a ``2023-Q1`` label."""
    parts = F.split(label, "-Q")
    return parts.getItem(0).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")


def month_name(month: Column) -> Column:
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    return F.when(month.between(1, 12), F.get(names, month - 1))


def month_label(date: Column) -> Column:
    """``Jan 2024``."""
    return F.date_format(date, "MMM yyyy")


def season(month: Column) -> Column:
    result = None
    for label, months in SEASONS.items():
        hit = month.isin(*months)
        result = F.when(hit, F.lit(label)) if result is None else result.when(hit, F.lit(label))
    return result.otherwise(F.lit(SEASON_DEFAULT))


def days_between_or(end: Column, start: Column, default: int = 30) -> Column:
    """Days from start to end, or the default when either date is missing."""
    return F.coalesce(F.datediff(end, start), F.lit(default))
