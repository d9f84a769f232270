from __future__ import annotations

import math
import random
import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlake.functions import dates, nulls, numbers, text
from marketlake.operators import features, history, importance, market, merging, periods, quality
from marketlake.operators.grouped import summarize, with_group_mean
from marketlake.plans import cleaning
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, values repeat, some are null."""
    dice = random.Random(3)
    data = [("hot", float(dice.randint(0, 400)) / 4, dice.randint(0, 9)) for _ in range(5000)]
    data += [("equal", 7.0, 1)] * 300 + [(None, 1.0, 3), (None, 2.0, None), ("one", 5.0, 4), ("none", None, None)]
    data += [(f"k{i % 40}", dice.gauss(100, 30), dice.randint(0, 3)) for i in range(1000)]
    return data, spark.createDataFrame(data, "k string, x double, d int").repartition(7)


@pytest.mark.parametrize("accuracy", [40, 200, 10_000])
def test_medians_are_exact_for_any_group_size(skewed, accuracy):
    data, df = skewed
    found = {r.k: r for r in summarize(df, ["k"], {"n": F.count("x")}, {"mx": "x", "md": "d"}, accuracy).collect()}
    assert set(found) == {k for k, _, _ in data}
    for key, row in found.items():
        for name, index in (("mx", 1), ("md", 2)):
            values = [r[index] for r in data if r[0] == key and r[index] is not None]
            want = statistics.median(values) if values else None
            assert (row[name] is None) == (want is None)
            assert want is None or row[name] == pytest.approx(want, abs=1e-9)


def test_large_and_small_groups_read_one_shuffle(skewed):
    plan = summarize(skewed[1], ["k"], {"n": F.count("x")}, {"mx": "x"})._jdf.queryExecution()
    assert "BroadcastNestedLoopJoin" not in plan.toString() and "CartesianProduct" not in plan.toString()


def test_group_mean_drops_null_keys(skewed):
    joined = with_group_mean(skewed[1], ["k"], {"m": F.avg("x")})
    assert joined.where("k is null").count() == 0 and joined.where("k = 'one'").first().m == 5.0


def test_previous_value_matches_plain_window(spark):
    dice = random.Random(5)
    start = date(2020, 1, 1)
    data = [(dice.choice(["hot"] * 5 + ["a", "b", None]), start + timedelta(days=dice.randint(0, 20)), i, float(i)) for i in range(400)]
    df = spark.createDataFrame(data, "k string, day date, id int, v double")
    plain = df.withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy("day", "id")))
    for chunk in (F.col("day"), F.trunc("day", "month")):
        assert rows(history.with_previous(df, "k", chunk, ["day", "id"], {"before": "v"})) == rows(plain)


def test_previous_by_range_matches_plain_window(spark):
    dice = random.Random(6)
    start = date(2020, 1, 1)
    data = [(dice.choice(["hot"] * 5 + ["a", "b", None]), start + timedelta(days=dice.randint(0, 3)), i, None if i % 9 == 0 else float(i)) for i in range(600)]
    df = spark.createDataFrame(data, "k string, day date, id int, v double").repartition(5)
    plain = df.withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy("day", "id")))
    for ranges in (1, 3, 40):
        assert rows(history.previous_by_range(df, "k", ["day", "id"], {"before": "v"}, ranges)) == rows(plain)
    assert history.previous_by_range(df.limit(0), "k", ["day", "id"], {"before": "v"}, 4).collect() == []


def test_one_key_and_day_spread_over_ranges(spark):
    """All rows share key and day: no range holds more than about its share, and the chain stays whole."""
    df = spark.range(0, 20_000).selectExpr("'hot' as k", "date'2024-01-01' as day", "id", "cast(id as double) as v").repartition(4)
    sizes = [r["count"] for r in history.in_ranges(df, ["k", "day", "id"], 20).groupBy("__range").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2_500 and sum(sizes) == 20_000
    found = history.previous_by_range(df, "k", ["day", "id"], {"before": "v"}, 20)
    assert found.where("before is null").count() == 1 and found.where("before != v - 1").count() == 0


def test_large_dictionary_is_dense_in_name_order(spark):
    names = [f"n{k * 37 % 1000:04d}" for k in range(1000)] + [None, "n0001", "Ünlü", ""]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(6)
    assert rows(history.large_dictionary(df, "name", "i", 13)) == rows(history.dictionary(df, "name", "i"))
    plan = history.large_dictionary(df, "name", "i", 13)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("__offset")[0] and history.large_dictionary(df.limit(0), "name", "i").collect() == []


def test_previous_null_value_is_not_skipped(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0)], "k string, t int, v double")
    found = history.with_previous(df, "k", F.col("t"), ["t"], {"p": "v"}).orderBy("t").collect()
    assert [r.p for r in found] == [None, 1.0, None]


def test_row_numbers_are_dense_and_ordered(spark):
    df = spark.range(0, 3000, 7).repartition(5)
    found = history.number_rows(df, "id", "n", start=1000, parts=8).orderBy("id").collect()
    assert [r.n for r in found] == list(range(1000, 1000 + len(found)))


def test_trend_line_of_short_series(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("a", 3, 6.0), ("b", 1, 5.0)], "k string, t int, y double")
    found = {(r.k, r.t): r for r in history.trend_line(df, ["k"], ["t"], "y").collect()}
    assert found["a", 3].fitted == pytest.approx(6.0) and found["a", 1].slope == pytest.approx(2.0)
    assert found["b", 1].fitted == 5.0


def test_upsert_twice_is_once(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    batch = spark.createDataFrame([(2, "x"), (3, "y")], "id int, v string")
    once = merging.upsert(target, batch, ["id"])
    assert rows(once) == [(1, "a"), (2, "x"), (3, "y")] == rows(merging.upsert(once, batch, ["id"]))
    repeated = batch.union(spark.createDataFrame([(2, "z")], "id int, v string"))
    assert (2, "z") in rows(merging.upsert(target, repeated, ["id"], ["v"]))


def test_keep_one_and_sources(spark):
    df = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (2, 5, None)], "id int, t int, v string")
    assert rows(merging.keep_one(df, ["id"], ["t"])) == [(1, 1, "early"), (2, 5, None)]
    stream = spark.createDataFrame([(1, 0, "s"), (3, 0, "s")], "id int, t int, v string")
    assert rows(merging.combine_sources(df.where("t > 1"), stream, "id", ["t"])) == [(1, 2, "late"), (2, 5, None), (3, 0, "s")]
    sides = {r.side: r.ids for r in merging.reconcile(df, stream, "id").collect()}
    assert sides == {"both": 1, "batch_only": 1, "stream_only": 1}


def test_key_violations(spark):
    child = spark.createDataFrame([(1, 10), (1, 11), (2, None)], "id int, p int")
    parent = spark.createDataFrame([(10,)], "p int")
    found = {r.rule: r.violations for r in merging.key_violations(child, "t", [["id"]], ["p"], [("p", parent, "p")]).collect()}
    assert found == {"unique(id)": 1, "not_null(p)": 1, "foreign_key(p)": 1}


def test_outliers_constant_null_and_stored_limits(spark):
    data = [(float(i % 5), 3.0, None) for i in range(40)] + [(100.0, 3.0, None), (None, 3.0, None)]
    df = spark.createDataFrame(data, "x double, c double, n double")
    flagged = quality.flag_outliers(df, ["x", "c", "n"])
    assert flagged.where("x_anomaly").select("x").collect() == [(100.0,)]
    assert flagged.where("c_anomaly or n_anomaly").count() == 0
    assert flagged.where("has_anomaly is null").count() == 0
    stored = quality.flag_outliers(df, ["x"], stats={"x": (2.0, 1.0)})
    assert stored.where("x_anomaly").count() == 1
    assert "NestedLoop" not in flagged._jdf.queryExecution().toString()


def test_scores(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("", None, False), (None, 2.0, True)], "t string, x double, has_anomaly boolean")
    scored = [r.data_quality_score for r in quality.quality_score(df, ["t", "x", "absent"]).collect()]
    assert scored == pytest.approx([70.0, 0.0, 35.0])
    assert quality.quality_score(df, ["absent"]).first().data_quality_score == 0.0


def test_completeness_of_an_empty_table(spark):
    found = quality.completeness_report(spark.createDataFrame([], "a int, b string")).collect()
    assert {(r.column_name, r.filled_pct, r.missing_pct, r.type) for r in found} == {("a", 0.0, 0.0, "int"), ("b", 0.0, 0.0, "string")}


def test_profile_lists_few_values_only(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("few"), F.lit("x").alias("t"))
    found = quality.column_profile(df).where("entry = 'value'")
    assert {(r.column_name, r.text_value) for r in found.collect()} == {("few", "0"), ("few", "1"), ("few", "2"), ("t", "x")}


def sales(spark):
    data, i = [], 0
    for year, month, price in [(2020, m, 100.0 + m) for m in range(1, 13)] + [(2021, 1, 300.0), (2021, 3, 150.0)]:
        for extra in (0.0, 10.0):
            i += 1
            data.append((i, price + extra, date(year, month, 5), date(year, month, 1), "R", "C", "N1", "flat"))
    data += [(900, 50.0, date(2020, 6, 1), None, "R2", "C2", "N2", "house"), (901, 60.0, date(2020, 6, 2), None, None, None, None, "house")]
    return spark.createDataFrame(data, "property_id int, price double, transaction_date date, listing_date date, "
                                       "region string, city string, neighborhood string, property_type string")


def test_trends_union_and_moving_average(spark):
    trends = periods.price_trends(sales(spark)).cache()
    counts = {r.period_type: r["count"] for r in trends.groupBy("period_type").count().collect()}
    assert counts["moving_avg_3m"] == counts["monthly"] == 14 + 1 + 1
    assert sum(counts.values()) == trends.count() and set(counts) == {*periods.GRAINS, "moving_avg_3m"}
    series = {(r.sale_year, r.sale_month): r for r in trends.where("period_type = 'moving_avg_3m' and region = 'R'").collect()}
    # Frames count rows, not months: February 2021 is missing, so March looks back to December.
    assert series[2021, 3].moving_avg_3m == pytest.approx((117.0 + 305.0 + 155.0) / 3)
    assert series[2020, 1].moving_avg_3m == series[2020, 1].avg_price == 106.0
    assert trends.where("period_type = 'quarterly' and period_value = 'Q1'").count() == 2
    averages = periods.moving_averages(trends)
    assert averages.where("moving_avg_type = 'neighborhood' and avg_price_12m is not null").count() == 0
    one = averages.withColumn("w1", periods.moving_average(averages, ["moving_avg_type", "region", "city", "neighborhood"], "avg_price", 1))
    assert one.where("abs(w1 - avg_price) > 1e-9").count() == 0


def test_seasonal_index_averages_to_one(spark):
    seasons = periods.seasonal_variations(periods.price_trends(sales(spark)))
    assert seasons.where("region is null and neighborhood is null").count() == 0
    means = seasons.groupBy("region", "neighborhood").agg(F.avg("seasonal_index").alias("m")).collect()
    assert all(abs(r.m - 1) < 1e-3 for r in means)
    june = seasons.where("neighborhood = 'N2'").first()
    assert (june.month_name, june.season, june.seasonal_index) == ("Juin", "Été", 1.0)


def test_market_across_and_within_years(spark):
    across = market.market_indicators(sales(spark)).where("neighborhood = 'N1'")
    january = across.where("sale_year = 2021 and sale_month = 1").first()
    assert january.prev_month_price == 117.0 and january.avg_days_on_market == 4.0
    within = market.market_indicators(sales(spark), within_year=True).where("neighborhood = 'N1' and sale_month = 1")
    assert {r.prev_month_price for r in within.collect()} == {None}
    missing = market.market_indicators(sales(spark)).where("neighborhood = 'N2'").first()
    assert missing.avg_days_on_market == 30.0 and missing.market_status == "Marché stable"
    everywhere = market.market_indicators(sales(spark).drop("neighborhood", "city")).first()
    assert everywhere.location_type == "global"


def test_market_status_first_match(spark):
    cases = [(6.0, 3.0, None, "Marché en forte hausse"), (5.0, 3.0, None, "Marché en hausse"), (-6.0, -3.0, 20.0, "Marché en forte baisse"),
             (-5.0, -3.0, 20.0, "Marché en baisse"), (1.0, -1.0, 11.0, "Marché ralenti"), (1.0, -1.0, -11.0, "Marché accéléré"),
             (None, 5.0, None, "Marché stable"), (0.0, 0.0, 10.0, "Marché stable")]
    df = spark.createDataFrame(cases, "s double, p double, d double, want string")
    assert df.where(market.market_status(F.col("s"), F.col("p"), F.col("d")) != F.col("want")).count() == 0


def test_year_over_year_needs_the_year_before(spark):
    df = spark.createDataFrame([("a", 2018, 1, 100.0), ("a", 2020, 1, 200.0), ("a", 2021, 1, 300.0)],
                               "n string, sale_year int, sale_month int, avg_price double")
    found = market.with_year_over_year(df, ["n"]).orderBy("sale_year").collect()
    assert [r.yoy_pct for r in found] == [None, None, 50.0]


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "A B"), (2, "A-B"), (3, "c"), (4, None)], "id int, t string")
    lists = features.category_lists(df, ["t"])
    hot = df.select("*", *features.one_hot(df, lists))
    assert hot.columns == ["id", "t", "t_a_b", "t_a_b_2", "t_c"]
    sums = [r[0] for r in hot.orderBy("id").select(F.col("t_a_b") + F.col("t_a_b_2") + F.col("t_c")).collect()]
    assert sums == [1, 1, 1, 0]
    with pytest.raises(ValueError):
        features.category_lists(spark.range(50), ["id"], at_most=10)


def test_ratios_and_trend_join(spark):
    df = spark.createDataFrame([(6.0, 2, 0), (6.0, None, 3)], "rooms double, bed int, bath int")
    found = df.select(*features.room_ratios(F.col("rooms"), F.col("bed"), F.col("bath"))).collect()
    assert [tuple(r) for r in found] == [(3.0, 6.0), (6.0, 2.0)]
    rows_in = spark.createDataFrame([("n", 2020, 1, 50.0), ("x", 2020, 1, 50.0)],
                                    "neighborhood string, transaction_year int, transaction_month int, target_price double")
    trends = spark.createDataFrame([("neighborhood_monthly", "n", 2020, 1, 100.0, 90.0)],
                                   "period_type string, neighborhood string, sale_year int, sale_month int, avg_price double, median_price double")
    joined = {r.neighborhood: r.price_to_neighborhood_ratio for r in features.with_neighborhood_trend(rows_in, trends).collect()}
    assert joined == {"n": 0.5, "x": 1.0}


def test_importance_constant_and_single_category(spark):
    df = spark.createDataFrame([(float(i), 1.0, 2.0 * i, "one", "ab"[i % 2]) for i in range(10)],
                               "x double, c double, price double, s string, t string")
    ranked = {r.feature_name: r for r in importance.feature_importance(df, ["x", "c"], ["s", "t"]).collect()}
    assert ranked["x"].correlation_with_price == pytest.approx(1.0) and ranked["c"].correlation_with_price is None
    assert ranked["t"].correlation_with_price == 1.0 and ranked["s"].correlation_with_price == 0.0
    assert ranked["s"].category_count == 1 and ranked["s"].importance_rank == 3


def test_guarded_numbers(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    found = df.select(numbers.ratio(a, b), numbers.pct_change(a, b), numbers.ratio_or_numerator(a, b)).collect()
    assert [tuple(r) for r in found] == [(None, None, 1.0), (None, None, 1.0), (1.5, 50.0, 1.5)]
    assert df.agg(numbers.correlation(F.lit(1.0), b)).first()[0] is None


def test_dates_and_text(spark):
    df = spark.createDataFrame([(2020, 1, " a \t b "), (2020, 13, ""), (None, 2, None)], "y int, m int, t string")
    y, m, t = F.col("y"), F.col("m"), F.col("t")
    assert [r[0] for r in df.select(dates.mid_month(y, m)).collect()] == [date(2020, 1, 15), None, None]
    assert [r[0] for r in df.select(text.squash_spaces(t)).collect()] == ["a b", "", None]
    assert [r[0] for r in df.select(nulls.text_or_default(t, "?")).collect()] == [" a \t b ", "?", "?"]
    assert [r[0] for r in df.select(dates.month_name(m)).collect()] == ["Janvier", None, "Février"]


def test_cleaning_of_listings(spark):
    data = [(str(i), "100.5" if i else "abc", " 12  rue\tA ", "7500 1", "MAISON", "true", "2020-01-0" + str(1 + i % 9)) for i in range(25)]
    data += [("99", "9000000", "", None, None, "maybe", "not a date")]
    df = spark.createDataFrame(data, "id string, price string, address string, postal_code string, property_type string, "
                                     "has_pool string, listing_date string")
    cleaned = {r.id: r for r in cleaning.clean(df, "static").collect()}
    good, bad, odd = cleaned["3"], cleaned["0"], cleaned["99"]
    assert (good.price, good.address, good.postal_code, good.property_type, good.has_pool) == (100.5, "12 rue A", "75001", "maison", True)
    assert good.listing_date == date(2020, 1, 4) and good.source_system == "static" and good.data_quality_score == 100.0
    assert bad.price == 0.0
    assert odd.listing_date is None and odd.has_pool is False and odd.postal_code == "00000" and odd.address == "Adresse inconnue"
    assert odd.has_anomaly and odd.price_anomaly and odd.data_quality_score == pytest.approx(70.0)


def test_nan_and_tokens(spark):
    df = spark.createDataFrame([(math.nan, "NA"), (1.0, "x")], "x double, t string")
    found = df.select(nulls.nan_to_null(F.col("x")), nulls.null_token(F.col("t"))).collect()
    assert [tuple(r) for r in found] == [(None, None), (1.0, "x")]


def test_upsert_keeps_the_later_row_and_refuses_unordered_repeats(spark):
    target = spark.createDataFrame([(1, 5, "new"), (2, 1, "old")], "id int, t int, v string")
    batch = spark.createDataFrame([(1, 0, "late"), (2, 3, "newer"), (3, 1, "first"), (3, 2, "second")], "id int, t int, v string")
    found = merging.upsert(target, batch, ["id"], ["t"])
    assert rows(found) == [(1, 5, "new"), (2, 3, "newer"), (3, 2, "second")]
    with pytest.raises(Exception, match="twice in the batch"):
        merging.upsert(target, batch, ["id"]).collect()


def test_one_of_each_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (None, 0, "x"), (None, 0, "y"), (2, 0, "c"), (2, 0, "c")], "id int, r int, v string")
    assert rows(merging.one_of_each(df, ["id"], ["r"])) == sorted([(1, 0, "a"), (2, 0, "c"), (None, 0, "x"), (None, 0, "y")], key=repr)


def test_one_hot_of_many_categories(spark):
    df = spark.range(1500).select("id", F.concat(F.lit("v"), "id").alias("t"), F.lit(None).cast("string").alias("u"))
    assert len(features.category_lists(df, ["t"])["t"]) == 1500
    long = features.one_hot_rows(df, "id", ["t", "u"])
    assert long.count() == 1500 and long.where("feature = 't_v7'").select("id", "value").collect() == [(7, 1)]


def test_steady_mean_does_not_depend_on_the_order(spark):
    values = [0.1 * k for k in range(400)] + [201.5, 1e6 / 3]
    means = {tuple(spark.createDataFrame([(float(v),) for v in values[::step]], "v double").repartition(3).agg(
        numbers.steady_mean("v")).first()) for step in (1, -1)}
    assert len(means) == 1
