from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marketlake.operators.quality import stored_stats
from marketlake.streaming import streams
from tests.conftest import rows

SCHEMA = "id bigint, ts timestamp, kind string, price double"
START = datetime(2024, 1, 1)


def put(spark, folder, events):
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def event(i, minutes, kind="a", price=1.0):
    return (i, START + timedelta(minutes=minutes), kind, price)


def source(spark, folder):
    return streams.read_files(spark, folder, spark.createDataFrame([], SCHEMA).schema)


def test_landing_and_restart(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    put(spark, folder, [event(i, i * 30) for i in range(100)])
    for expected in (100, 100, 110):
        if expected == 110:
            put(spark, folder, [event(200 + i, 0) for i in range(10)])
        streams.land(source(spark, folder), "ts", out, checkpoint).awaitTermination()
        assert spark.read.parquet(out).count() == expected
    landed = spark.read.parquet(out)
    assert {"year", "month", "day", "hour", "source_type"} <= set(landed.columns)
    assert landed.where("hour != hour(ts)").count() == 0


def test_sliding_equals_batch_for_closed_windows(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    put(spark, folder, [event(i, i * 7, "ab"[i % 2], float(i)) for i in range(200)])
    streams.write_append(
        streams.sliding(source(spark, folder), "ts", ["kind"], "price", "1 hour", "20 minutes"), out, checkpoint).awaitTermination()
    # A later file closes the windows still open.
    put(spark, folder, [event(1000, 5000)])
    streams.write_append(
        streams.sliding(source(spark, folder), "ts", ["kind"], "price", "1 hour", "20 minutes"), out, checkpoint).awaitTermination()
    batch = streams.sliding(spark.read.parquet(folder).where("id < 1000"), "ts", ["kind"], "price", "1 hour", "20 minutes")
    assert rows(spark.read.parquet(out).select(batch.columns)) == rows(batch)


def test_late_rows_are_counted(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    progress = []
    for events in ([event(1, 0), event(2, 300)], [event(3, 5), event(4, 240), event(5, 241)], [event(6, 1000)]):
        put(spark, folder, events)
        query = streams.write_append(streams.first_of_each(source(spark, folder), "id", "ts"), out, checkpoint)
        query.awaitTermination()
        progress += query.recentProgress
    assert streams.late_rows(progress) == 2  # at 5 and at 240: an hour behind 300 or more
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 5, 6]


def test_late_rows_are_dropped(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for events in ([event(1, 0), event(2, 300)], [event(3, 5)], [event(4, 1000)], [event(5, 2000)]):
        put(spark, folder, events)
        streams.write_append(streams.sliding(source(spark, folder), "ts", [], "price", "1 hour"), out, checkpoint).awaitTermination()
    first = spark.read.parquet(out).where(F.col("window_start") == F.lit(START)).collect()
    assert [r.rows for r in first] == [1]


def test_dedup_first_of_each(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    put(spark, folder, [event(i, i) for i in range(50)])
    put(spark, folder, [event(i, i) for i in range(20)])
    streams.write_append(streams.first_of_each(source(spark, folder), "id", "ts"), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 50


def test_clean_stream_uses_stored_limits(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    history = spark.createDataFrame([event(i, i, "a", float(i % 5)) for i in range(50)], SCHEMA)
    stats = stored_stats(history, ["price"])
    put(spark, folder, [event(1, 0, "a", 2.0), event(2, 0, "a", 500.0)])
    for _ in range(2):
        streams.clean_stream(source(spark, folder), out, checkpoint, stats, key_columns=["id", "price"]).awaitTermination()
    found = {r.id: r for r in spark.read.parquet(out).collect()}
    assert set(found) == {1, 2} and found[2].price_anomaly and not found[1].has_anomaly
    assert found[1].source_system == "streaming" and found[1].data_quality_score == 100.0


def test_upsert_stream_keeps_latest(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for events in ([event(1, 0, "a", 1.0), event(2, 1, "b", 2.0)], [event(3, 2, "a", 9.0), event(4, 3, "c", 4.0), event(5, 4, "c", 5.0)]):
        put(spark, folder, events)
        streams.upsert_stream(source(spark, folder), out, checkpoint, ["kind"], ["kind"], ["ts", "id"]).awaitTermination()
    assert rows(spark.read.parquet(out).select("kind", "price")) == [("a", 9.0), ("b", 2.0), ("c", 5.0)]
