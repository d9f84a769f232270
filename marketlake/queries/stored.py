"""Tables that are built once and then read, as marts and feature tables are in production."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlake.session import shared_dir
from marketlake.sources.files import exists, file_system, write_table


def input_state(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """Name, size and time of every file below the folder: a changed input never meets an old table."""
    fs, path = file_system(spark, folder)
    files, found = fs.listFiles(path, True), []
    while files.hasNext():
        status = files.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found)


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The named table from the shared folder, written there first if this application has not done so yet.

    Reading it back cuts the lineage: a lost executor costs a file read, not the build.
    """
    place = hashlib.sha256(repr((folder, input_state(spark, folder))).encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{place}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        write_table(build(spark, folder), path, parts=())
    return spark.read.parquet(path)
