"""Casts, text clean-up, defaults, null tokens, filters and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.functions import ids, nulls, text
from marketlake.operators import periods
from marketlake.operators.history import dictionary, large_dictionary, number_rows
from marketlake.plans import cleaning
from marketlake.queries.base import MONTHLY, NEIGHBORHOOD, SALES, Family, r_all, rounded
from marketlake.queries.quality import LABELLED, labelled_documents
from marketlake.queries.trends import STATS_DIGITS
from marketlake.sources.orders_market import sales_view, table

family = Family()


@family.add("clean_cast", """
select l_orderkey, l_linenumber, try_cast(l_returnflag as double) as flag_number, cast(l_quantity as double) as quantity,
  case l_linestatus when 'O' then null else try_cast(lower(l_linestatus) as boolean) end as status_flag,
  cast(l_shipdate as date) as ship_date, try_cast(l_returnflag as date) as flag_date
from lineitem""")
def clean_cast(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag_number"),
        F.col("l_quantity").cast("string").alias("quantity"), F.col("l_linestatus").alias("status_flag"),
        F.col("l_shipdate").cast("string").alias("ship_date"), F.col("l_returnflag").alias("flag_date"))
    return cleaning.cast_columns(
        lines, numeric=["flag_number", "quantity", "absent"], boolean=["status_flag"], date=["ship_date", "flag_date"])


@family.add("clean_text", r"""
select doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) as text,
  regexp_replace(lang, '[ \t\n\x0B\f\r]+', '', 'g') as lang, lower(source) as source from documents""")
def clean_text(spark, folder):
    documents = table(spark, folder, "documents").drop("n_chars")
    return cleaning.normalise_text(documents, squash=["text", "absent"], strip=["lang"], lower=["source"])


@family.add("clean_select_or_default", """
select doc_id, lang, cast('Inconnu' as varchar) as region, cast(0.0 as double) as surface, cast(null as date) as sold_on,
  cast(n_chars as double) as n_chars from documents""")
def clean_select_or_default(spark, folder):
    documents = table(spark, folder, "documents")
    return documents.select(
        "doc_id", nulls.col_or(documents, "lang"), nulls.col_or(documents, "region", "Inconnu", "string"),
        nulls.col_or(documents, "surface", 0.0, "double"), nulls.col_or(documents, "sold_on", None, "date"),
        nulls.col_or(documents, "n_chars", 0.0, "double"))


@family.add("clean_fill_numeric", f"""
with {LABELLED} select doc_id, lang, n_chars, coalesce(quality, -1) as quality, coalesce(toxic, 0) as toxic from labelled""")
def clean_fill_numeric(spark, folder):
    rows = labelled_documents(spark, folder).select("doc_id", "lang", "n_chars", "quality", "toxic")
    return cleaning.fill_zero(cleaning.fill_defaults(rows, numeric={"quality": -1, "absent": 0}))


@family.add("clean_fill_text", """
select doc_id, case when nullif(source, 'web') is null or nullif(source, 'web') = '' then 'inconnu' else source end as source,
  coalesce(nullif(lang, 'en'), 'Pas de description') as lang from documents""")
def clean_fill_text(spark, folder):
    documents = table(spark, folder, "documents").select(
        "doc_id", F.nullif("source", F.lit("web")).alias("source"),
        F.coalesce(F.nullif("lang", F.lit("en")), F.lit("")).alias("lang"))
    return cleaning.fill_defaults(documents, text={"source": "inconnu", "lang": "Pas de description"})


@family.add("clean_null_tokens", """
select p_partkey, nullif(p_type, 'ECONOMY') as p_type, case when p_size = 7 then null else p_retailprice end as price from part""")
def clean_null_tokens(spark, folder):
    not_a_number = F.when(F.col("p_size") == 7, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    return table(spark, folder, "part").select(
        "p_partkey", nulls.null_token(F.col("p_type"), "ECONOMY").alias("p_type"),
        nulls.nan_to_null(not_a_number).alias("price"))


@family.add("clean_period_filter", f"""
with {SALES} select * replace ({r_all(STATS_DIGITS)}) from ({MONTHLY}) where region is not null and region <> ''""")
def clean_period_filter(spark, folder):
    stats = periods.period_stats(sales_view(spark, folder), grains=["monthly", "neighborhood_monthly"])
    kept = stats.where((F.col("period_type") == "monthly") & F.col("region").isNotNull())
    return rounded(kept, STATS_DIGITS)


@family.add("clean_rename", f"""
with {SALES} select neighborhood, sale_year as trend_year, sale_month as trend_month, avg_price as neighborhood_avg_price
from ({NEIGHBORHOOD})""")
def clean_rename(spark, folder):
    stats = periods.period_stats(sales_view(spark, folder), grains=["neighborhood_monthly"])
    return stats.select("neighborhood", "sale_year", "sale_month", "avg_price", "median_price").withColumnsRenamed(
        {"sale_year": "trend_year", "sale_month": "trend_month", "avg_price": "neighborhood_avg_price"}
    ).drop("median_price")


@family.add("clean_hash_id")
def clean_hash_id(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", ids.hash_id(F.col("c_name")).alias("small_id"), ids.hash_id(F.col("c_name"), 10000).alias("id"),
        ids.wide_hash_id(F.col("c_name")).alias("wide_id"))


@family.add("clean_surrogate_id")
def clean_surrogate_id(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", F.monotonically_increasing_id().alias("property_id"))


@family.add("clean_row_number", """
select o_orderkey, 999 + row_number() over (order by o_orderkey) as property_id from orders""")
def clean_row_number(spark, folder):
    """Dense ids from 1000 on in key order."""
    return number_rows(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", "property_id", start=1000)


@family.add("clean_dictionary_id", """
select n_name, cast(row_number() over (order by n_name) as int) as city_id from (select distinct n_name from nation)""")
def clean_dictionary_id(spark, folder):
    return dictionary(table(spark, folder, "nation"), "n_name", "city_id")


@family.add("clean_large_dictionary_id", """
select c_name, row_number() over (order by c_name) as customer_id from (select distinct c_name from customer)""")
def clean_large_dictionary_id(spark, folder):
    """Dense ids of names that grow with the data, numbered by ranges."""
    return large_dictionary(table(spark, folder, "customer"), "c_name", "customer_id")


@family.add("clean_column_suffix", """
select distinct o_orderpriority, 'priority_' || lower(replace(replace(o_orderpriority, ' ', '_'), '-', '_')) as column_name
from orders""")
def clean_column_suffix(spark, folder):
    """Column names made from data values; the driver names the same columns when it builds a one-hot list."""
    name = F.concat(F.lit("priority_"), F.lower(F.translate("o_orderpriority", " -", "__")))
    return table(spark, folder, "orders").select("o_orderpriority", name.alias("column_name")).distinct()


@family.add("clean_surrogate_id_unique", "select count(*) as rows, count(*) as ids, count(distinct o_orderkey) as keys from orders")
def clean_surrogate_id_unique(spark, folder):
    """Surrogate ids: as many as rows, whatever the partitions."""
    return clean_surrogate_id(spark, folder).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("property_id").alias("ids"), F.count_distinct("o_orderkey").alias("keys"))
