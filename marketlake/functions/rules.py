"""Row rules of the housing shape, as column expressions over whatever columns a table has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.dates import mid_month, one_month_before
from marketlake.functions.nulls import above, col_or, first_present, null_safe_sum
from marketlake.functions.numbers import ratio, steady_round
from marketlake.functions.text import like_ladder, membership_label, value_map

# Codes, labels and constants of the published housing tables.
HEATING_GRADES = {"Ex": "A", "Gd": "B", "TA": "C", "Fa": "D", "Po": "E"}
GRADE_UNKNOWN = "Non évalué"
PRICE_FACTOR = 10.0
PREVIOUS_PRICE_SHARE = 0.9
PREVIOUS_CHANGE_PCT = 10.0
LISTING_DEFAULT = "2008-12-01"
ADDRESS_PREFIX = "Propriété "
ADDRESS_UNKNOWN = "Adresse inconnue"
CITY, POSTAL_CODE, REGION = "Ames", "50010", "Iowa"
CENTRE_LONGITUDE, CENTRE_LATITUDE = -93.62, 42.03
PROXIMITY = {
    "Excellent": ("NoRidge", "NridgHt", "StoneBr"),
    "Bon": ("Somerst", "Timber", "Veenker", "Crawfor"),
    "Limité": ("BrkSide", "OldTown", "Edwards"),
}
PROXIMITY_DEFAULT = "Moyen"
ROOM_PARTS = ("BedroomAbvGr", "FullBath", "HalfBath", "KitchenAbvGr")
FLOOR_NUMBER = (("%1Story%", 1), ("%1.5%", 1), ("%2Story%", 2), ("%2.5%", 2), ("%SFoyer%", 1), ("%SLvl%", 1))
TOTAL_FLOORS = (("%1Story%", 1), ("%1.5%", 2), ("%2Story%", 2), ("%2.5%", 3), ("%SFoyer%", 1), ("%SLvl%", 2))
GARDEN_MIN_LOT = 5000
COOLING = {"Y": "Central AC", "N": "None"}
SELLERS = {"Family": "Particulier", "Abnorml": "Bancaire", "Partial": "Constructeur"}
SELLER_DEFAULT = "Standard"
BUYERS = (("%WD%", "Particulier"), ("%New%", "Premier acheteur"), ("%COD%", "Judiciaire"), ("%Con%", "Constructeur"))
BUYER_DEFAULT, BUYER_NO_COLUMN = "Autre", "Particulier"
FINANCING = (("%Conv%", "Conventionnel"), ("%FHA%", "FHA"), ("%VA%", "VA"), ("Cash", "Comptant"))
FINANCING_DEFAULT = "Conventionnel"
DAYS_ON_MARKET_DEFAULT = 60


def _has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def energy_rating(df: DataFrame) -> Column:
    return value_map(col_or(df, "HeatingQC", dtype="string"), HEATING_GRADES, GRADE_UNKNOWN)


def synthetic_price(quality: Column, area: Column, factor: float = PRICE_FACTOR) -> Column:
    return (quality * area * F.lit(factor)).cast("double")


def price(df: DataFrame, price_column: str | None = None) -> Column:
    """A mapped price column, else the synthetic price, else null."""
    if price_column and _has(df, price_column):
        return F.col(price_column).try_cast("double")
    if _has(df, "OverallQual", "LotArea"):
        return synthetic_price(F.col("OverallQual"), F.col("LotArea"))
    return F.lit(None).cast("double")


def transaction_date(df: DataFrame) -> Column:
    if _has(df, "YrSold", "MoSold"):
        return mid_month(F.col("YrSold"), F.col("MoSold"))
    return F.lit(None).cast("date")


def listing_date(df: DataFrame) -> Column:
    """One month before the sale; January goes back to December of the year before."""
    if _has(df, "YrSold", "MoSold"):
        return one_month_before(transaction_date(df))
    return F.lit(LISTING_DEFAULT).cast("date")


def age_at_sale(sold: Column, built: Column) -> Column:
    return (sold - built).cast("int")


def price_per_area(amount: Column, area: Column) -> Column:
    return steady_round(ratio(amount, F.when(area > 0, area)), 2)


def address(df: DataFrame) -> Column:
    if _has(df, "Neighborhood", "Id"):
        return F.concat(F.lit(ADDRESS_PREFIX), F.col("Id").cast("string"), F.lit(", "), F.col("Neighborhood"))
    return F.lit(ADDRESS_UNKNOWN)


def pseudo_coordinate(name: Column, position: int, centre: float) -> Column:
    """A stable offset of the centre from one character of the name."""
    offset = (F.ascii(F.substring(name, position, 1)) % 10) / F.lit(100.0)
    return F.lit(centre) + offset.cast("double")


def coordinates(df: DataFrame) -> tuple[Column, Column]:
    if not _has(df, "Neighborhood"):
        return F.lit(CENTRE_LONGITUDE), F.lit(CENTRE_LATITUDE)
    name = F.col("Neighborhood")
    return pseudo_coordinate(name, 1, CENTRE_LONGITUDE), pseudo_coordinate(name, 2, CENTRE_LATITUDE)


def services_proximity(df: DataFrame) -> Column:
    return membership_label(col_or(df, "Neighborhood", dtype="string"), PROXIMITY, PROXIMITY_DEFAULT)


def total_rooms(df: DataFrame) -> Column:
    if _has(df, "TotRmsAbvGrd"):
        return F.col("TotRmsAbvGrd").cast("int")
    return null_safe_sum([F.col(c) for c in ROOM_PARTS if c in df.columns]).cast("int")


def bathrooms(df: DataFrame) -> Column:
    """Full baths plus half of the half baths."""
    if not (_has(df, "FullBath") or _has(df, "HalfBath")):
        return F.lit(None).cast("double")
    full, half = col_or(df, "FullBath", 0), col_or(df, "HalfBath", 0)
    return null_safe_sum([full.cast("double"), half * F.lit(0.5).cast("double")]).cast("double")


def floor_number(df: DataFrame) -> Column:
    return like_ladder(col_or(df, "HouseStyle", dtype="string"), FLOOR_NUMBER, 1).cast("int")


def total_floors(df: DataFrame) -> Column:
    return like_ladder(col_or(df, "HouseStyle", dtype="string"), TOTAL_FLOORS, 1).cast("int")


def present(column: Column) -> Column:
    """True for text that is neither null, empty nor the missing-value token."""
    return F.coalesce(~column.isin("NA", ""), F.lit(False))


def garage(df: DataFrame) -> Column:
    return present(col_or(df, "GarageType", dtype="string"))


def pool(df: DataFrame) -> Column:
    return above(col_or(df, "PoolArea", dtype="double"), 0)


def garden(df: DataFrame) -> Column:
    return above(col_or(df, "LotArea", dtype="double"), GARDEN_MIN_LOT)


def terrace(df: DataFrame) -> Column:
    return above(col_or(df, "WoodDeckSF", dtype="double"), 0) | above(col_or(df, "OpenPorchSF", dtype="double"), 0)


def roof_type(df: DataFrame) -> Column:
    return first_present(df, ["RoofMatl", "RoofStyle"])


def cooling_system(df: DataFrame) -> Column:
    return value_map(col_or(df, "CentralAir", dtype="string"), COOLING, None).cast("string")


def days_on_market(quality: Column, condition: Column) -> Column:
    return (F.lit(100) - quality * 8 + (F.lit(10) - condition) * 5).cast("int")


def days_on_market_of(df: DataFrame) -> Column:
    if _has(df, "OverallQual", "OverallCond"):
        return days_on_market(F.col("OverallQual"), F.col("OverallCond"))
    return F.lit(DAYS_ON_MARKET_DEFAULT).cast("int")


def previous_price(amount: Column, known: Column | None = None) -> Column:
    """Known earlier price, else the fixed share of today's price."""
    assumed = amount * F.lit(PREVIOUS_PRICE_SHARE)
    return assumed if known is None else F.coalesce(known, assumed)


def price_change_percentage(amount: Column, known: Column | None = None) -> Column:
    """Change from a known earlier price, else the fixed percentage."""
    assumed = F.lit(PREVIOUS_CHANGE_PCT)
    if known is None:
        return assumed
    return F.coalesce(steady_round(ratio(amount - known, F.when(known > 0, known)) * F.lit(100.0), 2), assumed)


def seller_type(df: DataFrame) -> Column:
    return value_map(col_or(df, "SaleCondition", dtype="string"), SELLERS, SELLER_DEFAULT)


def buyer_type(df: DataFrame) -> Column:
    if not _has(df, "SaleType"):
        return F.lit(BUYER_NO_COLUMN)
    return like_ladder(F.col("SaleType"), BUYERS, BUYER_DEFAULT)


def financing_type(df: DataFrame) -> Column:
    return like_ladder(col_or(df, "SaleType", dtype="string"), FINANCING, FINANCING_DEFAULT)
