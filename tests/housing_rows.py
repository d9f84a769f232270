"""Hand-written housing rows: every rule's hit, miss, boundary and missing value occurs."""

from marketlake.sources.housing import housing_schema

COLUMNS = ["Id", "MSSubClass", "OverallQual", "OverallCond", "YearBuilt", "YrSold", "MoSold", "LotArea", "Neighborhood",
           "MSZoning", "HeatingQC", "TotRmsAbvGrd", "BedroomAbvGr", "FullBath", "HalfBath", "KitchenAbvGr", "HouseStyle",
           "GarageType", "PoolArea", "WoodDeckSF", "OpenPorchSF", "RoofMatl", "RoofStyle", "CentralAir", "SaleType",
           "SaleCondition", "Exterior1st", "Heating", "source"]

ROWS = [
    (1, 20, 7, 5, 2003, 2008, 2, 8450.0, "NoRidge", "RL", "Ex", 8, 3, 2, 1, 1, "2Story", "Attchd", 0.0, 0.0, 61.0, "CompShg", "Gable", "Y", "WD", "Normal", "VinylSd", "GasA", "static"),
    (2, 60, 6, 8, 1976, 2007, 1, 5000.0, "Veenker", "RL", "Gd", 6, 3, 2, 0, 1, "1Story", "NA", 512.0, 298.0, 0.0, "CompShg", "Gable", "N", "New", "Partial", "MetalSd", "GasA", "static"),
    (3, 60, 7, 5, None, 2008, 12, 5001.0, "OldTown", "RM", "TA", 6, 3, 2, 1, 1, "1.5Fin", "", None, 0.0, 0.0, "WdShake", "Hip", "X", "COD", "Abnorml", "VinylSd", "GasW", "static"),
    (4, 70, None, 5, 1915, 2006, 6, 0.0, "CollgCr", "RL", "Fa", 7, 3, 1, None, 1, "2.5Unf", None, 0.0, None, 35.0, None, "Gable", None, "ConLD", "Family", "Wd Sdng", "GasA", "static"),
    (5, 60, 8, None, 2000, 2008, 12, None, None, "RL", "Po", 9, 4, None, None, None, "SLvl", "Detchd", 0.0, 192.0, 84.0, "CompShg", "Gable", "Y", "Cash", None, "VinylSd", "GasA", "static"),
    (6, 50, 5, 5, 1993, 2009, 10, 14115.0, "Somerst", "FV", "Zz", 5, 1, 1, 1, 1, "SFoyer", "Attchd", 0.0, 40.0, 30.0, "CompShg", "Gable", "Y", "CWD", "Normal", "VinylSd", "GasA", "static"),
    (7, 20, 8, 5, 2004, 2007, 8, 10084.0, "Edwards", "RL", None, 7, 3, 2, 0, 1, "Odd", "Attchd", 0.0, 255.0, 57.0, "CompShg", "Gable", "Y", None, "Normal", "VinylSd", "GasA", "static"),
]


def housing(spark, drop=()):
    frame = spark.createDataFrame(ROWS, housing_schema(COLUMNS))
    return frame.drop(*drop)
