"""The queries by name, each with the SQL that states the same result independently."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()

# The orders table with the defects that cleaning is for; the same text runs in Spark and as plain SQL.
DIRTY = """
WITH a AS (
  SELECT o_orderkey, o_custkey,
    CASE WHEN o_orderkey % 13 = 0 THEN 'N/A'
         WHEN o_orderkey % 11 = 0 THEN concat('  ', o_orderpriority, ' ')
         WHEN o_orderkey % 17 = 0 THEN NULL
         ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL
         WHEN o_orderkey % 101 = 0 THEN o_totalprice * 50
         ELSE o_totalprice END AS price,
    concat('$', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(30))) AS price_txt,
    CASE WHEN o_orderkey % 3 = 0 THEN 'F' WHEN o_orderkey % 3 = 1 THEN 'Female' ELSE 'm' END AS gender,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS order_day,
    'X' AS const_col
  FROM {orders})
SELECT * FROM a UNION ALL SELECT * FROM a WHERE o_orderkey % 50 = 0
"""
DIRTY_CTE = f"d AS ({DIRTY.format(orders='orders')})"


class Tables:
    """The tables of one folder, read when asked for; only the columns a query uses are scanned."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self[name]

    @cached_property
    def dirty(self) -> DataFrame:
        return self.spark.sql(DIRTY, orders=self["orders"])


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a name."""

    def add(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return function

    return add
