"""Types of the housing columns."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the published housing table by type; every other column is text.
INTEGERS = ("Id", "MSSubClass", "OverallQual", "OverallCond", "YearBuilt", "YearRemodAdd", "BsmtFullBath", "BsmtHalfBath",
            "FullBath", "HalfBath", "BedroomAbvGr", "KitchenAbvGr", "TotRmsAbvGrd", "Fireplaces", "GarageCars", "MoSold", "YrSold")
DOUBLES = ("LotFrontage", "LotArea", "MasVnrArea", "BsmtFinSF1", "BsmtFinSF2", "BsmtUnfSF", "TotalBsmtSF", "1stFlrSF",
           "2ndFlrSF", "LowQualFinSF", "GrLivArea", "GarageYrBlt", "GarageArea", "WoodDeckSF", "OpenPorchSF", "EnclosedPorch",
           "3SsnPorch", "ScreenPorch", "PoolArea", "MiscVal")


def housing_type(name: str) -> T.DataType:
    if name in INTEGERS:
        return T.IntegerType()
    if name in DOUBLES:
        return T.DoubleType()
    return T.TimestampType() if name == "timestamp" else T.StringType()


def housing_schema(names: list[str]) -> T.StructType:
    """Schema of a housing table with these columns, in this order."""
    return T.StructType([T.StructField(n, housing_type(n), n != "Id") for n in names])
