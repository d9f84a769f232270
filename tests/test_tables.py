from __future__ import annotations

import json
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.learn import models, store
from marketlake.plans import layers, serving, warehouse
from marketlake.plans.serving import Filters
from marketlake.session import shared_dir
from marketlake.sources import contracts, files, housing, jdbc
from tests.conftest import rows
from tests.housing_rows import housing as housing_frame

DAY, NEXT = date(2024, 3, 5), date(2024, 3, 6)


def numbers(spark, n, extra=0):
    return spark.range(n).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10 + extra).cast("int").alias("v"))


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_day_overwrite_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "t")
    for _ in range(2):
        files.write_table(files.with_run_date(numbers(spark, 5), DAY), root)
    files.write_table(files.with_run_date(numbers(spark, 3), NEXT), root)
    assert files.read_day(spark, root, DAY).count() == 5
    assert files.read_day(spark, root, date(2024, 1, 1)) is None
    assert files.read_latest(spark, root).count() == 3 and files.read_latest(spark, root, DAY).count() == 5
    assert files.read_latest(spark, root, date(2020, 1, 1)).count() == 3
    assert files.read_latest(spark, str(tmp_path / "empty")) is None
    plan = files.read_day(spark, root, DAY)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert files.drop_partitions_before(spark, root, NEXT) == [(2024, 3, 5)]
    assert files.partition_values(spark, root) == [(2024, 3, 6)]


def test_hours_formats_and_reconciliation(spark, tmp_path):
    root = str(tmp_path / "h")
    files.write_table(files.with_run_date(numbers(spark, 4), DAY, 7), root, (*files.DAY_PARTS, "hour"))
    assert files.read_day(spark, root, DAY, 7).count() == 4 and files.read_day(spark, root, DAY, 8) is None
    csv = str(tmp_path / "c")
    assert files.write_reconciled(numbers(spark, 6), csv, parts=(), format="csv") == (6, True)
    assert files.write_reconciled(numbers(spark, 6), str(tmp_path / "p"), parts=()) == (6, True)
    for day, n in ((DAY, 6), (NEXT, 4), (DAY, 5)):
        assert files.write_reconciled(files.with_run_date(numbers(spark, n), day), str(tmp_path / "d"), day) == (n, True)
    assert spark.read.option("header", True).csv(csv).count() == 6
    hashed = str(tmp_path / "x")
    files.write_hashed(files.with_run_date(numbers(spark, 50), DAY), hashed, "k")
    assert {r.part for r in spark.read.parquet(hashed).select("part").distinct().collect()} == {0, 1, 2}


def test_csv_tokens_and_types(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("Id,LotArea,GarageType\n1,8450.5,NA\n2,NA,Attchd\n")
    schema = housing.housing_schema(["Id", "LotArea", "GarageType"])
    assert [f.dataType for f in schema] == [T.IntegerType(), T.DoubleType(), T.StringType()]
    found = files.read_csv(spark, str(path), schema)
    assert rows(found) == [(1, 8450.5, None, "static"), (2, None, "Attchd", "static")]


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    root = str(tmp_path / "u")
    base = numbers(spark, 6).withColumn("part", F.col("k") % 3)
    files.upsert_table(spark, root, base, ["k", "part"], ["part"])
    untouched = sorted(p.name for p in Path(root, "part=2").glob("*.parquet"))
    batch = spark.createDataFrame([(0, 999, 0), (9, 90, 0)], "k int, v int, part int")
    for _ in range(2):
        files.upsert_table(spark, root, batch, ["k", "part"], ["part"])
    found = spark.read.parquet(root).select("k", "v")
    assert rows(found) == sorted([(0, 999), (9, 90)] + [(i, i * 10) for i in range(1, 6)], key=repr)
    assert untouched == sorted(p.name for p in Path(root, "part=2").glob("*.parquet"))


def test_jdbc_options_and_statements():
    options = jdbc.scan_options("jdbc:x", "t", {"user": "u"}, "id", (1, 100), 4)
    assert options["numPartitions"] == "4" and options["partitionColumn"] == "id" and options["user"] == "u"
    with pytest.raises(ValueError):
        jdbc.scan_options("jdbc:x", "t", partition_column="id")
    assert jdbc.replace_statement("t", ["a", "b"]) == "REPLACE INTO t (a, b) VALUES (%s, %s)"


class FakeConnection:
    """Records batches in files, as tasks run in other processes."""

    def __init__(self, folder):
        self.folder, self.batches = Path(folder), []

    def cursor(self):
        return self

    def executemany(self, statement, batch):
        self.batches.append([list(r) for r in batch])

    def commit(self):
        import uuid
        (self.folder / f"{uuid.uuid4().hex}.json").write_text(json.dumps(self.batches))

    def close(self):
        pass


def test_rows_are_sent_in_batches_from_tasks(spark, tmp_path):
    folder = str(tmp_path)
    jdbc.replace_rows(numbers(spark, 25).repartition(4), lambda: FakeConnection(folder), "x", batch_rows=4, connections=2)
    sent = [json.loads(p.read_text()) for p in tmp_path.glob("*.json")]
    assert len(sent) == 2 and all(len(b) <= 4 for batches in sent for b in batches)
    assert sorted(r[0] for batches in sent for b in batches for r in b) == list(range(25))


def test_conform_casts_rounds_and_refuses(spark):
    df = spark.createDataFrame(
        [(1, "f", "numeric", "v1", 0.125)],
        "feature_id bigint, feature_name string, feature_category string, model_version string, global_importance_score double")
    found = contracts.conform(df, contracts.FEATURE_IMPORTANCE)
    assert [f.dataType for f in found.schema] == [f.dataType for f in contracts.FEATURE_IMPORTANCE.schema]
    row = found.first()
    assert str(row.global_importance_score) == "0.13" and row.correlation_with_price is None and row.created_at is not None
    for required in ("feature_name", "feature_category"):  # declared NOT NULL
        with pytest.raises(ValueError):
            contracts.conform(df.drop(required), contracts.FEATURE_IMPORTANCE)
    with pytest.raises(PySparkException):
        contracts.conform(df.withColumn("feature_name", F.lit(None).cast("string")), contracts.FEATURE_IMPORTANCE).collect()
    with pytest.raises(PySparkException):
        contracts.conform(df.withColumn("global_importance_score", F.lit(12345.0)), contracts.FEATURE_IMPORTANCE).collect()


def test_contract_violations(spark):
    features = spark.createDataFrame([(1, "a"), (1, "b")], "feature_id int, feature_name string")
    variation = spark.createDataFrame([(1, 1), (7, 1)], "feature_id int, region_id int")
    found = {(r.table_name, r.rule): r.violations for r in contracts.violations(
        {"dm_feature_importance": features, "dm_regional_feature_variation": variation}).collect()}
    assert found["dm_feature_importance", "unique(feature_id)"] == 1
    assert found["dm_feature_importance", "unique(feature_name)"] == 0
    assert found["dm_regional_feature_variation", "foreign_key(feature_id)"] == 1


def trend_mart(spark):
    return spark.createDataFrame(
        [(1, "A", 2020, 1, 100.0, 90.0, 10), (1, "A", 2020, 2, 200.0, 190.0, 30), (2, "B", 2021, 5, 50.0, 40.0, 5)],
        "region_id int, region_name string, period_year int, period_month int, avg_price double, median_price double, transaction_count int"
    ).withColumns({"min_price": F.col("avg_price") - 5, "max_price": F.col("avg_price") + 5})


def test_serving_filters(spark):
    mart = trend_mart(spark)
    every = {r.region_name: r.avg_price for r in serving.price_by_region(mart).collect()}
    assert every == {"A": 150.0, "B": 50.0}
    assert serving.price_by_region(mart, weighted=True).first().avg_price == 175.0
    window = Filters(start=date(2020, 1, 2), end=date(2021, 4, 30))
    assert [r.period_month for r in serving.price_series(mart, window).collect()] == [2]
    assert serving.price_series(mart, Filters(region="B")).count() == 1
    assert serving.price_series(mart, Filters(property_types=("x",))).count() == 3
    assert [r[0] for r in serving.regions(mart).collect()] == ["A", "B"]
    empty = serving.date_range(mart.where("false")).first()
    assert (empty.max_date - empty.min_date).days == 365
    assert serving.date_range(mart).first() == (date(2020, 1, 1), date(2021, 5, 1))


def test_filters_reach_the_file_scan(spark, tmp_path):
    path = str(tmp_path / "mart")
    files.write_table(trend_mart(spark), path, parts=())
    stored = spark.read.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # the plan text cuts long filter lists otherwise
    plan = serving.price_by_region(stored, Filters(region="A", start=DAY, end=NEXT))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(region_name,A)" in plan and "GreaterThanOrEqual(period_year,2024)" in plan
    assert "created_at" not in plan


def test_serving_scaling(spark):
    mart = trend_mart(spark)
    scaled = {r.period_month: r for r in serving.scaled_to_ten(mart, ["avg_price"], ["avg_price"]).collect()}
    assert scaled[2].avg_price_norm == 0.0 and scaled[1].avg_price_norm == 5.0
    assert {r.price_ratio for r in serving.min_max_ratio(mart.where("region_name = 'B'"), "avg_price").collect()} == {0.5}
    assert "NestedLoop" not in serving.min_max_ratio(mart, "avg_price")._jdf.queryExecution().toString()


def test_feature_matrix_row_means_are_one(spark):
    df = spark.createDataFrame([("f", "A", 1.0), ("f", "B", 3.0), ("g", "A", 2.0)], "feature_name string, region_name string, relative_importance double")
    found = {r.feature_name: (r.A, r.B) for r in serving.feature_matrix(df, ["A", "B"]).collect()}
    assert found == {"f": (0.5, 1.5), "g": (1.0, None)}


def test_serving_of_models(spark):
    models = spark.createDataFrame(
        [("m1", "Linear", "v1", datetime(2024, 1, 1), '{"r2": 0.5}', False), ("m2", "Forest", "v1", datetime(2024, 1, 1), '{"r2": 0.9, "rmse": 3}', True)],
        "model_id string, model_name string, model_version string, training_date timestamp, model_metrics string, is_active boolean")
    listed = serving.model_list(models).collect()
    assert [(r.model_id, r.r2, r.rmse) for r in listed] == [("m2", 0.9, 3.0), ("m1", 0.5, 0.0)]
    assert serving.active_model(models).first().model_id == "m2"
    results = spark.createDataFrame(
        [(f"p{i:02d}", i, float(i), 0.0, 2.0 * i, 0.8, "m2" if i % 2 else "m1", '{"a": 0.25, "b": 0.75}') for i in range(60)],
        "prediction_id string, property_id int, predicted_price double, prediction_interval_low double, "
        "prediction_interval_high double, confidence_score double, model_id string, feature_contributions string")
    first = serving.predictions(results, models).collect()
    assert len(first) == 20 and [r.prediction_id for r in first][:2] == ["p01", "p03"]
    best = serving.prediction_intervals(results).collect()
    assert len(best) == 10 and best[0].interval_width == 118.0 and best[0].confidence_pct == 80.0
    parts = serving.contributions(results.where("prediction_id = 'p00'")).collect()
    assert [(r.feature, r.contribution) for r in parts] == [("b", 0.75), ("a", 0.25)]


def test_all_layers_twice(spark, tmp_path):
    rows_in = housing_frame(spark).drop("source")
    stream = rows_in.where("Id in (1, 2)").withColumn("Neighborhood", F.lit("FromStream")).unionByName(
        rows_in.where("Id = 3").withColumn("Id", F.lit(50)))
    columns = {"outlier_columns": ("LotArea", "OverallQual"), "key_columns": ("Id", "LotArea", "Neighborhood")}
    counts = []
    for _ in range(2):
        layout = layers.run(spark, {"static": rows_in, "streaming": stream}, str(tmp_path), DAY, **columns)
        counts.append({n: spark.read.parquet(layout.path("gold", n)).count() for n in (
            "price_trends", "feature_importance", "price_prediction_features", "market_indicators", "seasonal_variations", "moving_averages")})
    assert counts[0] == counts[1] and counts[0]["price_prediction_features"] == 8 and counts[0]["feature_importance"] == 13
    located = {r.property_id: r.neighborhood for r in spark.read.parquet(layout.path("silver", "location_details")).collect()}
    assert len(located) == 8 and located[1] == "NoRidge" and located[50] == "OldTown"
    scores = {r.property_id: r.data_quality_score for r in spark.read.parquet(layout.path("silver", "property_details")).collect()}
    assert scores[1] == 100.0 and scores[5] == pytest.approx(100 / 3)
    marts = layers.mart_tables(spark, layout)
    assert contracts.violations(marts).where("violations > 0").count() == 0
    units = {r.neighborhood_name: r.price_per_sqft for r in marts["dm_neighborhood_comparison"].collect()}
    assert any(v is not None for v in units.values())
    for name, table in marts.items():
        assert [f.name for f in table.schema] == [f.name for f in contracts.CONTRACTS[name].schema]
    assert layers.latest(spark, layout, "gold", "price_trends").count() == counts[0]["price_trends"]
    with pytest.raises(FileNotFoundError):
        layers.build_dimensions(spark, ["static"], layout, NEXT)


def scanned(df):
    """Rows that the file scan of an executed query gave out."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    for k in range(leaves.length()):
        found.append(leaves.apply(k).metrics().apply("numOutputRows").value())
    return sum(found)


def test_filters_prune_a_clustered_mart(spark, tmp_path):
    """A region, and a region with months, read the ranges that hold them."""
    mart = spark.range(24_000).selectExpr(
        "concat('R', lpad(cast(id % 40 as string), 2, '0')) as region_name", "cast(1990 + id div 40 % 30 as int) as period_year",
        "cast(id div 1200 % 12 + 1 as int) as period_month", "id as v").repartition(5)
    plain, clustered = str(tmp_path / "plain"), str(tmp_path / "clustered")
    mart.write.parquet(plain)
    files.write_clustered(mart, clustered, ["region_name", "period_year", "period_month"], 20)
    for wanted in (serving.Filters(region="R07"), serving.Filters(region="R07", start=date(1995, 1, 1), end=date(1996, 6, 30))):
        old, new = (serving.apply_filters(spark.read.parquet(p), wanted) for p in (plain, clustered))
        assert rows(old) == rows(new) and new.count() > 0
        assert scanned(new) <= 2_600 < scanned(old) == 24_000


def test_model_layer_merges_both_marts(spark, tmp_path):
    """A day's second run changes nothing; the next day's models are added, and only the newest best one stays active."""
    base = housing_frame(spark).drop("source")
    many = base.crossJoin(spark.range(40).toDF("copy")).withColumns({
        "Id": (F.col("Id") + 10 * F.col("copy")).cast(base.schema["Id"].dataType),
        "LotArea": (F.coalesce("LotArea", F.lit(5000.0)) + F.pmod(F.col("copy") * 977, F.lit(4000))).cast(base.schema["LotArea"].dataType)}).drop("copy")
    columns = {"outlier_columns": ("LotArea", "OverallQual"), "key_columns": ("Id", "LotArea", "Neighborhood")}
    grids = {models.FOREST: {"numTrees": [2, 3], "maxDepth": [2, 4]}, models.BOOSTING: {"maxIter": [2, 3]}}
    seen = []
    for day in (DAY, DAY, NEXT):
        layout = layers.run(spark, {"static": many}, str(tmp_path), day, grids=grids, **columns)
        tables = layers.mart_tables(spark, layout)
        seen.append([sorted(map(tuple, tables[n].collect()), key=repr) for n in ("dm_prediction_models", "dm_prediction_results")])
        assert contracts.violations(tables).where("violations > 0").count() == 0
        active = [r for r in tables["dm_prediction_models"].collect() if r.is_active]
        assert len(active) == 1 and active[0].training_date.date() == day and store.exists(spark, active[0].model_path)
    assert seen[0] == seen[1] and len(seen[0][0]) == 3 and seen[0][1]
    assert len(seen[2][0]) == 6 and len(seen[2][1]) == 2 * len(seen[0][1])
    served = serving.predictions(*(layers.mart_tables(spark, layout)[n] for n in ("dm_prediction_results", "dm_prediction_models")))
    assert served.count() == min(20, len(seen[0][1]))


def test_warehouse_views(spark):
    df = spark.createDataFrame([(1, 10.0, DAY, "R", "C", "N", "flat", 3)],
                               "property_id int, price double, transaction_date date, region string, city string, neighborhood string, property_type string, rooms int")
    assert len(warehouse.publish_views(df)) == 4
    assert spark.table("dw_property_features").columns == ["property_id", "rooms"]
    assert spark.sql("select properties_sold from dw_location_metrics").first()[0] == 1


def test_upsert_reads_touched_partitions_by_literals(spark, tmp_path):
    root = str(tmp_path / "p")
    files.upsert_table(spark, root, numbers(spark, 9).withColumn("part", F.col("k") % 3), ["k", "part"], ["part"], ["v"])
    batch = spark.createDataFrame([(0, -5, 0), (3, 999, 0)], "k int, v int, part int")
    files.upsert_table(spark, root, batch, ["k", "part"], ["part"], ["v"])
    assert rows(spark.read.parquet(root).where("part = 0").select("k", "v")) == [(0, 0), (3, 999), (6, 60)]
    plan = spark.read.parquet(root).where(files.any_partition(["part"], [(0,), (None,)]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "part" in text.split("PartitionFilters: [")[1].split("]")[0] and "DataFilters: []" in text


def test_load_check_counts_what_is_written(spark, tmp_path):
    sent, complete = files.write_reconciled(numbers(spark, 25), str(tmp_path / "r"), parts=())
    assert (sent, complete) == (25, True)
