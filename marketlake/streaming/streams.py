"""Streams: landing, cleaning by micro-batch, windows with late data, de-duplication, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marketlake.plans.cleaning import clean
from marketlake.sources.files import upsert_table, write_table

LATE = "1 hour"


def read_files(spark: SparkSession, folder: str, schema: T.StructType, format: str = "parquet", **options) -> DataFrame:
    """New files of a folder as they arrive. Another source differs only in its format name and options."""
    return spark.readStream.schema(schema).format(format).options(**options).load(folder)


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Event time as an instant; a watermark does not accept a time without zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def land(stream: DataFrame, time: str, path: str, checkpoint: str, source: str = "streaming") -> StreamingQuery:
    """Append every row once, in directories by year, month, day and hour of the event."""
    at = F.col(time)
    rows = stream.withColumns({
        "source_type": F.lit(source), "processing_timestamp": F.current_timestamp(),
        "year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at), "hour": F.hour(at)})
    return (
        rows.writeStream.format("parquet").partitionBy("year", "month", "day", "hour").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clean_stream(stream: DataFrame, path: str, checkpoint: str, stats: dict[str, tuple[float, float]], **columns) -> StreamingQuery:
    """Clean each micro-batch with stored outlier limits. A batch writes its own partition, so a replay of
    the same batch after a failure replaces it."""
    def handle(batch: DataFrame, number: int) -> None:
        cleaned = clean(batch, "streaming", outlier_columns=list(stats), stats=stats, **columns)
        write_table(cleaned.withColumn("batch", F.lit(number)), path, ("batch",))

    return for_each_batch(stream, handle, checkpoint)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], parts: list[str], order: list[str]) -> StreamingQuery:
    """Keep a keyed table current: each micro-batch replaces the rows it names, in the partitions it touches."""
    def handle(batch: DataFrame, number: int) -> None:
        batch.persist()  # read several times: touched partitions, anti-join, new rows
        try:
            upsert_table(batch.sparkSession, path, batch, keys, parts, order)
        finally:
            batch.unpersist()

    return for_each_batch(stream, handle, checkpoint)


def sliding(df: DataFrame, time: str, keys: list[str], value: str, size: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """Count and mean per window and key; the same call works on a table and on a stream.

    On a stream, rows later than ``late`` are dropped and each window is emitted once, when it can no longer
    change. Partial aggregation keeps a hot key cheap.
    """
    rows = df.withWatermark(time, late) if df.isStreaming else df
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counted = rows.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(value).alias("mean_value"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "rows", "mean_value")


def first_of_each(stream: DataFrame, key: str, time: str, late: str = LATE) -> DataFrame:
    """One row per id: the first that arrives, within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def write_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def late_rows(progress: list) -> int:
    """Rows that the watermark kept out of the state, over all reported batches of a query."""
    return sum(state.numRowsDroppedByWatermark for p in progress for state in p.stateOperators)
