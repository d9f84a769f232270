"""Hash identifiers and hash splits. All are row-local: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_id(column: Column, modulus: int = 1000) -> Column:
    """Small id from a name. Names can collide; use a dictionary id where ids must be unique."""
    return F.abs(F.hash(column).cast("bigint")) % modulus


def wide_hash_id(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def hash_bucket(column: Column, buckets: int) -> Column:
    """Bucket 0 … buckets-1; the same value always lands in the same bucket."""
    return F.pmod(F.hash(column), F.lit(buckets))


def hash_share(column: Column, seed: int = 42) -> Column:
    """0 … 99 from an id, for splits that do not change with partitioning."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(100)).cast("int")
