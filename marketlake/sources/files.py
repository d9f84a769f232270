"""Partitioned file tables: landing, latest-partition reads, keyed merges by partition, retention."""

from __future__ import annotations

import uuid
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.operators.merging import upsert
from marketlake.session import shared_dir

DAY_PARTS = ("year", "month", "day")


def file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target)


def partition_values(spark: SparkSession, root: str, parts=DAY_PARTS) -> list[tuple[int, ...]]:
    """Values of the partition directories below ``root``, sorted. Only directories are listed, no file is read."""
    fs, _ = file_system(spark, root)
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([root, *[f"{p}=*" for p in parts]]))
    found = set()
    for status in fs.globStatus(pattern) or []:
        pieces = status.getPath().toString().split("/")[-len(parts):]
        found.add(tuple(int(piece.split("=", 1)[1]) for piece in pieces))
    return sorted(found)


def _is_partition(parts, values) -> Column:
    condition = F.lit(True)
    for name, value in zip(parts, values):
        condition = condition & (F.col(name) == value)
    return condition


def with_run_date(df: DataFrame, run_date: date, hour: int | None = None) -> DataFrame:
    stamps = {"year": F.lit(run_date.year), "month": F.lit(run_date.month), "day": F.lit(run_date.day)}
    if hour is not None:
        stamps["hour"] = F.lit(hour)
    return df.withColumns(stamps)


def write_table(
        df: DataFrame, path: str, parts=DAY_PARTS, format: str = "parquet", mode: str = "overwrite", seen: Observation | None = None) -> None:
    """Write by partition; overwriting replaces only the partitions present, so a rerun leaves one copy.

    The rebalance hint lets the adaptive engine size the files and split a partition that holds most rows.
    ``seen`` counts the rows behind that shuffle, in the tasks that write them, so that a repeated task counts once.
    """
    rows = df.hint("rebalance", *parts) if parts else df.hint("rebalance")
    if seen is not None:
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = rows.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", True)
    if parts:
        writer = writer.partitionBy(*parts).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def write_clustered(df: DataFrame, path: str, columns: list[str], files: int | None = None) -> None:
    """Write rows in ranges of the columns, sorted within each file, so that a filter on them skips files and row groups by
    their least and largest values. Rows that share all columns stay in one file; name enough columns to part a hot one."""
    ranged = df.repartitionByRange(files, *columns) if files else df.repartitionByRange(*columns)
    ranged.sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder of the shared folder and read back: evaluated once, whatever is built on it."""
    path = f"{shared_dir(df.sparkSession)}/scratch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_reconciled(df: DataFrame, path: str, day: date | None = None, **options) -> tuple[int, bool]:
    """Write one day (or a table without partitions) and compare rows sent with rows landed.

    Rows are counted while they are written; counting what landed reads the day's file footers only.
    """
    seen = Observation()
    write_table(df, path, seen=seen, **options)
    landed = df.sparkSession.read.format(options.get("format", "parquet")).option("header", True).load(path)
    if day is not None:
        landed = landed.where(_is_partition(DAY_PARTS, (day.year, day.month, day.day)))
    rows = seen.get["rows"]
    return rows, landed.count() == rows


def read_day(spark: SparkSession, root: str, day: date, hour: int | None = None) -> DataFrame | None:
    """Exactly one day (and hour), or nothing. The filter on partition columns prunes the other directories."""
    parts, wanted = list(DAY_PARTS), [day.year, day.month, day.day]
    if hour is not None:
        parts, wanted = parts + ["hour"], wanted + [hour]
    if tuple(wanted) not in partition_values(spark, root, parts):
        return None
    return spark.read.parquet(root).where(_is_partition(parts, wanted))


def read_latest(spark: SparkSession, root: str, day: date | None = None, parts=DAY_PARTS) -> DataFrame | None:
    """The given day when it exists, else the newest partition by value."""
    values = partition_values(spark, root, parts)
    if not values:
        return None
    wanted = (day.year, day.month, day.day) if day else None
    return spark.read.parquet(root).where(_is_partition(parts, wanted if wanted in values else values[-1]))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, source: str = "static") -> DataFrame:
    """Headed CSV with a given schema; the missing-value token becomes null and the source is named."""
    rows = spark.read.schema(schema).option("header", True).option("nullValue", "NA").option("enforceSchema", False).csv(path)
    return rows.withColumn("source", F.lit(source))


def write_hashed(df: DataFrame, path: str, key: str, buckets: int = 3, parts=DAY_PARTS) -> None:
    """Horizontal partitioning by a hash of the key, above the date directories."""
    hashed = df.withColumn("part", F.pmod(F.hash(key), F.lit(buckets)))
    write_table(hashed, path, ("part", *parts))


def any_partition(parts: list[str], values: list) -> Column:
    """Filter for the partitions of the given values, a null value included."""
    one = [reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.lit(x)) for p, x in zip(parts, v, strict=True)]) for v in values]
    return reduce(lambda a, b: a | b, one)


def upsert_table(spark: SparkSession, root: str, batch: DataFrame, keys: list[str], parts: list[str], order: list[str] | None = None) -> None:
    """Replace rows by key in a partitioned table, rewriting only the partitions the batch touches.

    A key must stay in its partition (the partition columns are part of what identifies a row). The merged
    partitions are written to a staging folder first, so the table is never read and overwritten in one job;
    running the same batch again changes nothing. With ``order``, a late row does not replace a newer one. The values of
    the touched partitions (one row a directory) become literal filters, so other directories are never read.
    """
    if not exists(spark, root):
        write_table(upsert(batch.limit(0), batch, keys, order), root, parts)
        return
    touched = batch.select(*parts).distinct().collect()
    if not touched:
        return
    staging = f"{shared_dir(spark)}/staging/{uuid.uuid4().hex}"
    current = spark.read.parquet(root).where(any_partition(parts, touched))
    write_table(upsert(current, batch, keys, order), staging, parts)
    write_table(spark.read.parquet(staging), root, parts)
    fs, target = file_system(spark, staging)
    fs.delete(target, True)


def drop_partitions_before(spark: SparkSession, root: str, day: date) -> list[tuple[int, ...]]:
    """Delete whole day directories older than ``day``; returns their values."""
    fs, _ = file_system(spark, root)
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([root, *[f"{p}=*" for p in DAY_PARTS]]))
    dropped = []
    for status in fs.globStatus(pattern) or []:
        pieces = status.getPath().toString().split("/")[-len(DAY_PARTS):]
        value = tuple(int(piece.split("=", 1)[1]) for piece in pieces)
        if value < (day.year, day.month, day.day):
            fs.delete(status.getPath(), True)
            dropped.append(value)
    return sorted(dropped)
