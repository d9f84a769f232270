"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.session import shared_dir
from marketlake.sources.files import file_system

#: Rows and bytes in one Arrow batch, so that a batch of long texts stays small in a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Spark then deletes the shuffle files of a job when the job ends, and not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, and let them find this package (settings that change no result).

    The path holds where driver and executors share an installation; elsewhere the package is shipped with ``--py-files``.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextlib.contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of jobs started inside go with their job; the session's own setting holds again behind it.

    For jobs whose rows are written and whose plan is never run again: a second run would have to shuffle anew.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors, keeps no shuffle files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    with passing_shuffles(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` whose last reader is written."""
    for table in tables:
        fs, path = file_system(table.sparkSession, table._stored_at)
        fs.delete(path, True)


def portions(texts: list[bytes], size: int) -> Iterator[tuple[int, list[bytes]]]:
    """``texts`` in runs of about ``size`` bytes, each with the number of its first text."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        if k > first and held + len(t) > size:
            yield first, texts[first:k]
            first, held = k, 0
        held += len(t)
    if texts:
        yield first, texts[first:]


def give_back_memory() -> None:
    """Hand memory that a fit on the driver has freed back to the system; a driver goes on for long after it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps its own counsel
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def per_batch(work: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A ``mapInArrow`` function from one that turns a batch into a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return run


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def binary_parts(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def list_column(values: np.ndarray, lengths: np.ndarray | list[int], kind: pa.DataType) -> pa.Array:
    """A list column from the concatenated values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def held_out(doc_id: str = "doc_id"):
    """True for the rows whose crc32 of the id as text leaves 0 by 5: their labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
