"""Sources, sinks, row filters and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.functions.columns import loose_number, parsed_date
from datalumen.operators.rows import sample_head, slice_rows, top_rows
from datalumen.plans.registry import DIRTY_CTE, Tables, query
from datalumen.session import scratch_path
from datalumen.sources.readers import load
from datalumen.sources.writers import write_table

CUSTOMER = ("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment "
            "FROM customer")


@query("scan_parquet", """
SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1""")
def scan_parquet(t: Tables) -> DataFrame:
    orders = load(t.spark, f"{t.folder}/orders.parquet")
    recent = orders.filter(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    return recent.groupBy("o_orderstatus").agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("scan_csv", CUSTOMER)
def scan_csv(t: Tables) -> DataFrame:
    return load(t.spark, write_table(t.customer, scratch_path(t.spark, "customer") + ".csv", "csv"))


@query("scan_json", CUSTOMER)
def scan_json(t: Tables) -> DataFrame:
    path = write_table(t.customer, scratch_path(t.spark, "customer") + ".json", "json")
    return load(t.spark, path).select(*t.customer.columns)


@query("sink_csv_roundtrip", f"""
WITH {DIRTY_CTE} SELECT gender, count(*) AS orders, count(price) AS priced, round(sum(price), 2) AS total
FROM (SELECT DISTINCT * FROM d) GROUP BY gender""")
def sink_csv_roundtrip(t: Tables) -> DataFrame:
    path = write_table(t.dirty.dropDuplicates(), scratch_path(t.spark, "cleaned") + ".csv", "csv")
    return load(t.spark, path).groupBy("gender").agg(
        F.count("*").alias("orders"), F.count("price").alias("priced"), F.round(F.sum("price"), 2).alias("total"))


@query("sample_head", """
SELECT concat_ws(',', c_custkey, c_name, c_nationkey, c_mktsegment) AS line
FROM customer ORDER BY c_custkey LIMIT 20""")
def head(t: Tables) -> DataFrame:
    return sample_head(t.customer, [F.asc("c_custkey")], ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


@query("slice_isin", """
SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1""")
def slice_isin(t: Tables) -> DataFrame:
    return slice_rows(t.customer, "c_mktsegment", ["BUILDING", "MACHINERY"]).groupBy("c_mktsegment").agg(
        F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("dropna_subset", f"""
WITH {DIRTY_CTE} SELECT gender, count(*) AS rows_left FROM d
WHERE price IS NOT NULL AND priority IS NOT NULL GROUP BY 1""")
def dropna_subset(t: Tables) -> DataFrame:
    return t.dirty.dropna(subset=["price", "priority"]).groupBy("gender").agg(F.count("*").alias("rows_left"))


@query("top_rows", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def largest_orders(t: Tables) -> DataFrame:
    return top_rows(t.orders, "o_totalprice", ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("safe_cast", f"""
WITH {DIRTY_CTE} SELECT count(*) AS cells, count(TRY_CAST(priority AS DOUBLE)) AS priority_numbers,
  count(TRY_CAST(replace(price_txt, '$', '') AS DOUBLE)) AS price_numbers,
  round(sum(TRY_CAST(replace(price_txt, '$', '') AS DOUBLE)), 2) AS price_sum,
  count(TRY_CAST(order_day AS DATE)) AS days, count(TRY_CAST(gender AS DATE)) AS gender_days FROM d""")
def safe_cast(t: Tables) -> DataFrame:
    number, day = loose_number, parsed_date
    return t.dirty.agg(
        F.count("*").alias("cells"), F.count(number(F.col("priority"))).alias("priority_numbers"),
        F.count(number(F.col("price_txt"))).alias("price_numbers"),
        F.round(F.sum(number(F.col("price_txt"))), 2).alias("price_sum"),
        F.count(day(F.col("order_day"))).alias("days"), F.count(day(F.col("gender"))).alias("gender_days"))
