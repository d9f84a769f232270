"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores. Each query is built and run to a
sink that keeps nothing; marts and feature rows used by serving and model queries are stored on first use,
inside the timing of the first query that needs them. A query that fails, or runs longer than BENCH_LIMIT seconds (300), is named
with its reason under ``failed``; the others keep their figures, also if the bench is told to end.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import tempfile
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketlake.queries.catalog import all_queries  # noqa: E402
from marketlake.session import build_session  # noqa: E402

HEADLINE = (
    "trends_monthly", "trends_quarterly", "trends_neighborhood_monthly", "trends_type_quarterly", "trends_union",
    "trends_moving_averages", "trends_seasonal", "trends_reaggregate", "trends_regression",
    "market_indicators", "market_yoy", "market_momentum",
    "clean_cast", "clean_text", "clean_fill_text", "clean_row_number",
    "quality_stats", "quality_outlier_flags", "quality_score", "quality_completeness", "quality_column_profile",
    "rules_arithmetic", "rules_previous_price", "dims_property", "dims_location", "dims_building", "dims_sale_history",
    "join_dims_inner", "join_trend_left", "join_group_average", "io_upsert_merge", "io_key_violations",
    "importance_ranked", "importance_by_region", "importance_by_quarter", "features_one_hot", "features_table",
    "mart_regional_trends", "mart_neighborhoods", "mart_seasonal", "mart_feature_importance",
    "serving_price_by_region", "serving_price_trends", "serving_neighborhood_comparison", "serving_normalised",
    "ml_metrics", "ml_error_histogram", "ml_linear",
    "stream_dedup_batch", "stream_reconcile", "stream_sliding_batch", "stream_sliding",
    "ml_boosting", "ml_forest",  # the longest last
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    limit = float(os.environ.get("BENCH_LIMIT", "300"))

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    def limited(name: str) -> float:
        """As ``run``, with all jobs of a query that takes too long ended; threads of its own fits end with their jobs."""
        over = threading.Event()

        def end() -> None:
            over.set()
            while not done.wait(1.0):
                spark.sparkContext.cancelAllJobs()

        done, timer = threading.Event(), threading.Timer(limit, end)
        timer.start()
        try:
            return run(name)
        except Exception as error:
            raise TimeoutError(f"over {limit:.0f} s") if over.is_set() else error
        finally:
            timer.cancel()
            done.set()

    seconds, failed = {}, {}

    def report() -> None:
        print(json.dumps({
            "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
            "failed": failed, "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf")}), flush=True)

    def told_to_end(*_) -> None:
        failed.update((name, "not finished when the bench was ended") for name in HEADLINE if name not in seconds and name not in failed)
        report()
        os._exit(0)

    signal.signal(signal.SIGTERM, told_to_end)
    run("trends_monthly")  # warm-up
    for name in HEADLINE:
        try:
            seconds[name] = limited(name)
        except Exception as error:
            failed[name] = f"{type(error).__name__}: {error}".splitlines()[0][:200]
    report()
    spark.stop()


if __name__ == "__main__":
    main()
