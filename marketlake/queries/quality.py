"""Column statistics, outliers, scores, completeness and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.operators import quality
from marketlake.queries.base import Family, r, r_all, rounded
from marketlake.sources.orders_market import table

family = Family()
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STAT_DIGITS = {"mean": 6, "stddev": 6}


def labelled_documents(spark, folder):
    """Documents with their labels where they have any."""
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")


LABELLED = "labelled as (select d.*, quality, toxic from documents d left join labels using (doc_id))"


def _stats_sql(table_name: str, columns: list[str]) -> str:
    return " union all ".join(
        f"select '{c}' as column_name, {r(f'avg({c})', 6)} as mean, {r(f'stddev_samp({c})', 6)} as stddev, "
        f"cast(min({c}) as double) as min, cast(max({c}) as double) as max from {table_name}" for c in columns)


@family.add("quality_stats", _stats_sql("lineitem", LINE_NUMBERS))
def quality_stats(spark, folder):
    return rounded(quality.column_stats(table(spark, folder, "lineitem"), LINE_NUMBERS), STAT_DIGITS)


def _flag(c: str) -> str:
    return f"coalesce({c}_s > 0 and ({c} < {c}_m - 3 * {c}_s or {c} > {c}_m + 3 * {c}_s), false)"


@family.add("quality_outlier_flags", f"""
with {LABELLED}, s as (
  select avg(n_chars) as n_chars_m, stddev_samp(n_chars) as n_chars_s, avg(quality) as quality_m,
         stddev_samp(quality) as quality_s, avg(toxic) as toxic_m, stddev_samp(toxic) as toxic_s from labelled)
select doc_id, lang, n_chars, quality, toxic, {_flag('n_chars')} as n_chars_anomaly, {_flag('quality')} as quality_anomaly,
  {_flag('toxic')} as toxic_anomaly, {_flag('n_chars')} or {_flag('quality')} or {_flag('toxic')} as has_anomaly
from labelled, s""")
def quality_outlier_flags(spark, folder):
    rows = labelled_documents(spark, folder).select("doc_id", "lang", "n_chars", "quality", "toxic")
    return quality.flag_outliers(rows, ["n_chars", "quality", "toxic"])


@family.add("quality_outliers_by_group", """
with s as (select lang, avg(n_chars) as m, stddev_samp(n_chars) as sd from documents group by lang)
select doc_id, documents.lang, n_chars, coalesce(sd > 0 and (n_chars < m - 3 * sd or n_chars > m + 3 * sd), false)
  as n_chars_anomaly, coalesce(sd > 0 and (n_chars < m - 3 * sd or n_chars > m + 3 * sd), false) as has_anomaly
from documents join s on documents.lang = s.lang""")
def quality_outliers_by_group(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return quality.flag_outliers(rows, ["n_chars"], by=["lang"])


KEYS = ["doc_id", "text", "lang", "source", "quality", "missing_column"]
SQL_SCORE = " + ".join(
    f"(case when {c} is not null and cast({c} as varchar) <> '' then 1 else 0 end)" for c in KEYS[:-1])


@family.add("quality_score", f"""
with {LABELLED}, s as (select avg(n_chars) as n_chars_m, stddev_samp(n_chars) as n_chars_s from labelled)
select doc_id, {_flag('n_chars')} as has_anomaly,
  {r(f"({SQL_SCORE}) / 5.0 * 100 * (case when {_flag('n_chars')} then 0.7 else 1.0 end)", 6)} as data_quality_score
from labelled, s""")
def quality_score(spark, folder):
    flagged = quality.flag_outliers(labelled_documents(spark, folder), ["n_chars"])
    scored = quality.quality_score(flagged, KEYS)
    return rounded(scored.select("doc_id", "has_anomaly", "data_quality_score"), {"data_quality_score": 6})


REPORT_COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "quality": "int", "toxic": "int"}


@family.add("quality_completeness", f"with {LABELLED} " + " union all ".join(
    f"select '{c}' as column_name, count(*) as total_rows, count({c}) as filled, "
    f"{r(f'count({c}) * 100.0 / count(*)', 6)} as filled_pct, count(*) - count({c}) as missing, "
    f"{r(f'(count(*) - count({c})) * 100.0 / count(*)', 6)} as missing_pct, '{t}' as type from labelled"
    for c, t in REPORT_COLUMNS.items()))
def quality_completeness(spark, folder):
    report = quality.completeness_report(labelled_documents(spark, folder), list(REPORT_COLUMNS))
    return rounded(report, {"filled_pct": 6, "missing_pct": 6})


PROFILED_NUMBERS = ("c_nationkey", "c_acctbal")
PROFILED_VALUES = ("c_mktsegment", "c_nationkey")


@family.add("quality_column_profile", " union all ".join(
    [f"select '{c}' as column_name, '{s}' as entry, {r(f'{f}({c})', 6)} as number_value, null as text_value, null as rows "
     f"from customer" for c in PROFILED_NUMBERS
     for s, f in (("mean", "avg"), ("stddev", "stddev_samp"), ("min", "min"), ("max", "max"))]
    + [f"select '{c}', 'value', null, cast({c} as varchar), count(*) from customer group by {c}" for c in PROFILED_VALUES]))
def quality_column_profile(spark, folder):
    customers = table(spark, folder, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    return rounded(quality.column_profile(customers), {"number_value": 6})
