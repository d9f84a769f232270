"""Round trips through file tables: sinks, scans, newest partitions, load check, retention."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from marketlake.plans.cleaning import with_source
from marketlake.queries.base import Family
from marketlake.session import shared_dir
from marketlake.sources import files
from marketlake.sources.orders_market import table

family = Family()


def _place(spark) -> str:
    return f"{shared_dir(spark)}/roundtrips/{uuid.uuid4().hex}"


def _events_by_day(spark, folder):
    """The events written in directories by year, month and day; the folder."""
    at = F.col("ts")
    rows = table(spark, folder, "events").withColumns({"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at)})
    place = _place(spark)
    files.write_table(rows, place)
    return place


EVENTS = "select event_id, user_id, event_type, value from events"


@family.add("io_csv_round_trip", "select n_nationkey, n_name, n_regionkey, 'static' as source from nation")
def io_csv_round_trip(spark, folder):
    """A table as headed CSV and read again with its schema."""
    rows = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    place = _place(spark)
    files.write_table(rows, place, parts=(), format="csv")
    return files.read_csv(spark, place, rows.schema)


@family.add("io_partitioned_sink", """
select cast(year(ts) as int) as year, cast(month(ts) as int) as month, cast(day(ts) as int) as day, count(*) as rows
from events group by year(ts), month(ts), day(ts)""")
def io_partitioned_sink(spark, folder):
    stored = spark.read.parquet(_events_by_day(spark, folder))
    return stored.groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("rows"))


@family.add("io_read_day", f"{EVENTS} where cast(ts as date) = (select min(cast(ts as date)) from events)")
def io_read_day(spark, folder):
    """Exactly the first day."""
    place = _events_by_day(spark, folder)
    first = files.partition_values(spark, place)[0]
    return files.read_day(spark, place, date(*first)).select("event_id", "user_id", "event_type", "value")


@family.add("io_read_latest", f"{EVENTS} where cast(ts as date) = (select max(cast(ts as date)) from events)")
def io_read_latest(spark, folder):
    """The newest day, when the wanted one is not there."""
    place = _events_by_day(spark, folder)
    return files.read_latest(spark, place, date(1990, 1, 1)).select("event_id", "user_id", "event_type", "value")


@family.add("io_retention", f"{EVENTS} where cast(ts as date) > (select min(cast(ts as date)) from events)")
def io_retention(spark, folder):
    """What stays after the days before the second one are dropped."""
    place = _events_by_day(spark, folder)
    second = files.partition_values(spark, place)[1]
    files.drop_partitions_before(spark, place, date(*second))
    return spark.read.parquet(place).select("event_id", "user_id", "event_type", "value")


@family.add("io_reconciled", "select count(*) as sent, true as complete from lineitem")
def io_reconciled(spark, folder):
    """Rows sent and whether as many landed."""
    sent, complete = files.write_reconciled(table(spark, folder, "lineitem"), _place(spark), parts=())
    return spark.createDataFrame([(sent, complete)], "sent long, complete boolean")


@family.add("io_upsert_partitions", """
select event_type, cast(day(ts) as int) as day, max(event_id) as event_id, arg_max(value, event_id) as value
from events group by event_type, day(ts)""")
def io_upsert_partitions(spark, folder):
    """The event of highest id of each type and day, upserted in three batches: late rows never replace newer ones."""
    rows = table(spark, folder, "events").select("event_type", F.dayofmonth("ts").alias("day"), "event_id", "value")
    place = _place(spark)
    for part in (2, 1, 0):
        batch = rows.where(F.pmod(F.xxhash64("user_id"), F.lit(3)) == part)
        files.upsert_table(spark, place, batch, ["event_type", "day"], ["day"], ["event_id"])
    return spark.read.parquet(place).select("event_type", "day", "event_id", "value")


@family.add("clean_row_metadata", "select n_nationkey, 'orders' as source_system, true as stamped from nation")
def clean_row_metadata(spark, folder):
    """Every row names its source system and its processing time."""
    rows = with_source(table(spark, folder, "nation"), "orders")
    return rows.select("n_nationkey", "source_system", F.col("processing_timestamp").isNotNull().alias("stamped"))
