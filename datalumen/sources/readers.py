"""Tables from files, frames and databases."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalumen.functions.columns import PLAIN_NUMBER, col, hits, strip
from datalumen.plans.console import check_read_only

# Texts that the CSV reader takes as missing.
CSV_MISSING = ["", "#N/A", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "<NA>", "-nan", "-NaN"]


def load(spark: SparkSession, source: str | DataFrame, fmt: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """A table by path, by the extension of the path unless ``fmt`` is given; a DataFrame is passed through.

    Folders and globs work as paths. Unknown extensions are read as CSV.
    """
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str):
        raise TypeError(f"unsupported source: {type(source).__name__}")
    kind = (fmt or os.path.splitext(source.rstrip("/*"))[1].lstrip(".")).lower()
    if kind == "parquet":
        return spark.read.options(**options).parquet(source)
    if kind in ("json", "jsonl", "ndjson"):
        return read_json(spark, source, schema, **options)
    if kind in ("xls", "xlsx"):
        raise ValueError("convert spreadsheets to CSV or Parquet first")
    return read_csv(spark, source, schema, **options)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """CSV with a header; without a schema the types come from one pass over all values."""
    reader = spark.read.option("header", True).options(**options)
    if schema:
        return reader.schema(schema).csv(path)
    return typed(reader.csv(path, inferSchema=False))


def read_json(spark: SparkSession, path: str, schema: str | None = None, array: bool | None = None, **options) -> DataFrame:
    """JSON with one record per line, which Spark can split, or files that hold one array each, which it reads file by file.

    Without ``array`` the first sign that is not white space decides: a bracket opens an array.
    """
    if array is None:
        lines = spark.read.text(path).where(F.ltrim(F.translate("value", "\t\r\ufeff", "")) != "").select(F.ltrim(F.translate("value", "\t\r\ufeff", "")).alias("v"))
        first = lines.first()
        array = first is not None and first["v"].startswith("[")
    reader = spark.read.option("multiLine", array).options(**options)
    return (reader.schema(schema) if schema else reader).json(path)


def typed(raw: DataFrame) -> DataFrame:
    """Text columns to bigint, double or boolean where every value fits; missing-value texts become null."""
    gone = raw.select(*[F.when(~col(c).isin(CSV_MISSING), col(c)).alias(c) for c in raw.columns])
    aggs = []
    for i, c in enumerate(raw.columns):
        v = strip(col(c))
        aggs += [F.count(col(c)).alias(f"n{i}"),
                 hits(v.rlike(r"^[+-]?\d{1,18}$")).alias(f"int{i}"), hits(v.rlike(PLAIN_NUMBER)).alias(f"num{i}"),
                 hits(F.lower(v).isin("true", "false")).alias(f"bool{i}")]
    row = gone.agg(*aggs).first()
    casts = {}
    for i, c in enumerate(raw.columns):
        n = row[f"n{i}"]
        for kind, test in (("bigint", "int"), ("double", "num"), ("boolean", "bool")):
            if n and row[f"{test}{i}"] == n:
                casts[c] = strip(col(c)).try_cast(kind)
                break
    return gone.withColumns(casts)


def read_database(
    spark: SparkSession, url: str, query: str, partition: tuple[str, float, float, int] | None = None, **options
) -> DataFrame:
    """A read-only query against a database over JDBC.

    ``partition`` is ``(column, low, high, parts)``: Spark then reads the parts in parallel, as it should for
    anything large. Rows outside the bounds are read too, by the first and the last part.
    """
    check_read_only(query)
    text = query.strip().rstrip(";")
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition is None:
        return reader.option("query", text).load()
    column, low, high, parts = partition
    return reader.options(
        dbtable=f"({text}) q", partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()


def register(df: DataFrame, name: str) -> None:
    """Make a table known to the console under a name."""
    df.createOrReplaceTempView(name)
