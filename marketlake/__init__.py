"""Market analytics on Spark DataFrames: landing, cleaning, dimensions, trends, marts, serving, models."""

from marketlake.roles import Roles

__all__ = ["Roles"]
