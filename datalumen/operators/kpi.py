"""Business figures from columns found by their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.functions import fixed
from datalumen.functions.columns import col, hits, measure, share


def resolve_roles(columns: list[str], numeric: list[str], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Columns for revenue, units, customer and return; the first schema column with a known name wins."""

    def first(names: list[str], among: list[str]) -> str | None:
        return next((c for c in among if c.lower() in names), None)

    found = {
        "revenue": first(fixed.REVENUE_NAMES, numeric), "units": first(fixed.UNITS_NAMES, numeric),
        "customer": first(fixed.CUSTOMER_NAMES, columns), "returned": first(fixed.RETURN_NAMES, columns),
    }
    return {role: name for role, name in {**found, **(overrides or {})}.items() if name}


def kpi_sales(df: DataFrame, revenue: str, units: str | None = None) -> DataFrame:
    """Total, mean and largest sale, number of sales, and units sold."""
    v = measure(df, revenue)
    aggs = [F.round(F.sum(v), 2).alias("total_revenue"), F.round(F.avg(v), 2).alias("average_order_value"),
            F.round(F.max(v), 2).alias("max_transaction"), F.count(v).alias("transactions")]
    if units:
        aggs.append(F.floor(F.sum(measure(df, units))).cast("bigint").alias("units_sold"))
    return df.agg(*aggs)


def kpi_customers(df: DataFrame, customer: str) -> DataFrame:
    """Distinct and repeat customers, repeat rate and mean number of orders."""
    per = df.filter(col(customer).isNotNull()).groupBy(col(customer)).agg(F.count("*").alias("orders"))
    return per.agg(
        F.count("*").alias("unique_customers"), hits(F.col("orders") > 1).alias("repeat_customers"),
        share(hits(F.col("orders") > 1), F.nullif(F.count("*"), F.lit(0))).alias("repeat_rate"),
        F.round(F.avg("orders"), 2).alias("avg_orders_per_customer"))


def kpi_returns(df: DataFrame, returned: str, yes: list[str] | None = None) -> DataFrame:
    """Returned or exceptional rows, their rate, and the rest."""
    flag = hits(F.lower(col(returned).cast("string")).isin(yes or fixed.RETURN_YES))
    counted = df.agg(flag.alias("return_count"), F.count("*").alias("rows"))
    return counted.select(
        "return_count", share(F.col("return_count"), F.nullif(F.col("rows"), F.lit(0))).alias("return_rate"),
        (F.col("rows") - F.col("return_count")).alias("fulfilled"))
