"""Stream operators and their batch twins on the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketlake.operators import merging
from marketlake.operators.quality import column_stats
from marketlake.queries.base import Family, r, rounded
from marketlake.queries.quality import family as quality_family
from marketlake.queries.quality import labelled_documents
from marketlake.session import shared_dir
from marketlake.sources.files import scratch_table
from marketlake.sources.orders_market import table
from marketlake.streaming import streams

family = Family()
SIZE, SLIDE = "1 hour", "30 minutes"
OUTLIER_FLAGS = quality_family.sql["quality_outlier_flags"]


def events(spark, folder):
    return streams.event_time(table(spark, folder, "events"), "ts")


@family.add("stream_dedup_batch", """
select user_id, arg_min(event_id, (ts, event_id)) as event_id, min(ts) as ts from events group by user_id""")
def stream_dedup_batch(spark, folder):
    """The first event of each user."""
    rows = table(spark, folder, "events").select("user_id", "event_id", "ts")
    return merging.keep_one(rows, ["user_id"], ["ts", "event_id"])


@family.add("stream_reconcile", """
with b as (select event_id from events where event_type <> 'view'),
s as (select event_id from events where value > 10 or event_type = 'view')
select case when b.event_id is not null and s.event_id is not null then 'both'
            when s.event_id is null then 'batch_only' else 'stream_only' end as side, count(*) as ids
from b full join s on b.event_id = s.event_id group by 1""")
def stream_reconcile(spark, folder):
    """Every event is in the batch source, the stream source or both."""
    rows = table(spark, folder, "events")
    return merging.reconcile(rows.where("event_type <> 'view'"), rows.where("value > 10 or event_type = 'view'"), "event_id")


@family.add("stream_union_batch", """
select event_id, case when event_type <> 'view' then 'static' else 'streaming' end as source, value from events""")
def stream_union_batch(spark, folder):
    """Both sources in one table; an id in both keeps its batch row."""
    rows = table(spark, folder, "events").select("event_id", "ts", "event_type", "value")
    batch = rows.where("event_type <> 'view'").withColumn("source", F.lit("static"))
    stream = rows.where("value > 10 or event_type = 'view'").withColumn("source", F.lit("streaming"))
    return merging.combine_sources(batch, stream, "event_id", ["ts"]).select("event_id", "source", "value")


SLIDING = f"""
with starts as (select *, time_bucket(interval 30 minutes, ts) as s from events),
spread as (select *, s as window_start from starts union all select *, s - interval 30 minutes from starts)
select window_start, window_start + interval 1 hour as window_end, event_type, count(*) as rows, {r('avg(value)', 6)} as mean_value
from spread group by window_start, event_type"""


@family.add("stream_sliding_batch", SLIDING)
def stream_sliding_batch(spark, folder):
    counted = streams.sliding(events(spark, folder), "ts", ["event_type"], "value", SIZE, SLIDE)
    return _without_zone(rounded(counted, {"mean_value": 6}))


def _without_zone(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@family.add("stream_tumbling_batch", f"""
select time_bucket(interval 1 hour, ts) as window_start, time_bucket(interval 1 hour, ts) + interval 1 hour as window_end,
  event_type, count(*) as rows, {r('avg(value)', 6)} as mean_value from events group by time_bucket(interval 1 hour, ts), event_type""")
def stream_tumbling_batch(spark, folder):
    counted = streams.sliding(events(spark, folder), "ts", ["event_type"], "value", SIZE)
    return _without_zone(rounded(counted, {"mean_value": 6}))


BATCHES = 4


def _arrivals(rows, number):
    """``(folder of stream files, [writers])``: the rows of each micro-batch as files of their own, as many as Spark writes."""
    base = f"{shared_dir(rows.sparkSession)}/streams/{uuid.uuid4().hex}"
    numbered = scratch_table(rows.withColumn("__batch", number), "arrivals")

    def arrive(k):
        numbered.where(F.col("__batch") == k).drop("__batch").write.parquet(f"{base}/in/part={k}")

    return base, arrive


def _in_order(rows):
    """Number of the quarter of the events' time order."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = rows.select(micros.alias("s")).approxQuantile("s", [k / BATCHES for k in range(1, BATCHES)], 0.01)
    return sum(((micros > int(edge)).cast("int") for edge in edges), F.lit(0))


def _run(spark, rows, number, start):
    """``(what the stream wrote, progress of its batches)``: the micro-batches arrive one after another, each is read by a run of its own
    that goes on from the checkpoint of the one before, as a job does that is started whenever files have come."""
    base, arrive = _arrivals(rows, number)
    progress = []
    for k in range(BATCHES):
        arrive(k)
        stream = streams.read_files(spark, f"{base}/in/part=*", rows.schema)
        query = start(streams.event_time(stream, "ts") if "ts" in rows.columns else stream, f"{base}/out", f"{base}/checkpoint")
        query.awaitTermination()
        progress += query.recentProgress
    return spark.read.parquet(f"{base}/out"), progress


@family.add("stream_sliding", f"select * from ({SLIDING}) where window_end <= (select max(ts) - interval 1 hour from events)")
def stream_sliding(spark, folder):
    """Windows closed by the watermark; the last ones stay open, as more rows could still arrive."""
    rows = table(spark, folder, "events")
    closed, _ = _run(spark, rows, _in_order(rows), lambda stream, out, checkpoint: streams.write_append(
        streams.sliding(stream, "ts", ["event_type"], "value", SIZE, SLIDE), out, checkpoint))
    return _without_zone(rounded(closed, {"mean_value": 6}))


@family.add("stream_landing", """
select event_id, user_id, event_type, value, 'streaming' as source_type, cast(year(ts) as int) as year,
  cast(month(ts) as int) as month, cast(day(ts) as int) as day, cast(hour(ts) as int) as hour from events""")
def stream_landing(spark, folder):
    rows = table(spark, folder, "events")
    landed, _ = _run(spark, rows, _in_order(rows), lambda stream, out, checkpoint: streams.land(stream, "ts", out, checkpoint))
    return landed.select("event_id", "user_id", "event_type", "value", "source_type", "year", "month", "day", "hour")


@family.add("stream_dedup", "select event_id, user_id, event_type, value from events")
def stream_dedup(spark, folder):
    """Every event sent twice; the second copy is dropped."""
    rows = table(spark, folder, "events")

    def start(stream, out, checkpoint):
        twice = stream.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
        return streams.write_append(streams.first_of_each(twice, "event_id", "ts").select("event_id", "user_id", "event_type", "value"), out, checkpoint)

    return _run(spark, rows, _in_order(rows), start)[0]


@family.add("stream_upsert", """
select event_type, cast(day(ts) as int) as day, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value
from events group by event_type, day(ts)""")
def stream_upsert(spark, folder):
    """The latest event of each type and day, kept current batch by batch although later batches bring older events."""
    rows = table(spark, folder, "events")
    dealt = F.pmod(F.xxhash64("event_id"), F.lit(BATCHES)).cast("int")  # every batch but the first brings older events
    table_now, _ = _run(spark, rows, dealt, lambda stream, out, checkpoint: streams.upsert_stream(
        stream.select("event_type", F.dayofmonth("ts").alias("day"), "event_id", "value", "ts"), out, checkpoint, ["event_type", "day"], ["day"],
        ["ts", "event_id"]))
    return table_now.select("event_type", "day", "event_id", "value")


@family.add("stream_late_rows", f"""
with e as (select *, event_id % {BATCHES} as b from events),
top as (select b, max(max(ts)) over (order by b rows between unbounded preceding and 1 preceding) as before from e group by b),
told as (select e.*, coalesce(ts <= date_trunc('millisecond', before) - interval 1 hour, false) as late from e join top using (b))
select count(*) as rows_in, count(*) filter (where late) as rows_dropped, count(*) filter (where not late) as rows_written,
  sum(event_id) filter (where not late) as ids_written from told""")
def stream_late_rows(spark, folder):
    """Rows that come more than an hour behind the newest one before their batch: how many the watermark dropped, next to what was written."""
    rows = table(spark, folder, "events")
    written, progress = _run(spark, rows, F.pmod("event_id", F.lit(BATCHES)), lambda stream, out, checkpoint: streams.write_append(
        streams.first_of_each(stream, "event_id", "ts"), out, checkpoint))
    return written.agg(F.count(F.lit(1)).alias("rows_written"), F.sum("event_id").alias("ids_written")).select(
        F.lit(sum(p.numInputRows for p in progress)).cast("long").alias("rows_in"), F.lit(streams.late_rows(progress)).cast("long").alias("rows_dropped"),
        "rows_written", "ids_written")


@family.add("stream_clean", OUTLIER_FLAGS)
def stream_clean(spark, folder):
    """Documents cleaned batch by batch with the limits of the stored table: the flags are those of the table as a whole."""
    names = ["n_chars", "quality", "toxic"]
    rows = labelled_documents(spark, folder).select("doc_id", "lang", *names)
    limits = {r.column_name: (r["mean"], r["stddev"]) for r in column_stats(rows, names).collect()}
    cleaned, _ = _run(spark, rows, F.pmod("doc_id", F.lit(BATCHES)), lambda stream, out, checkpoint: streams.clean_stream(
        stream, out, checkpoint, limits, key_columns=("doc_id", "lang")))
    return cleaned.select("doc_id", "lang", *names, *[f"{c}_anomaly" for c in names], "has_anomaly")
