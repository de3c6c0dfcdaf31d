"""The table before cleaning against the table after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.functions.columns import col, is_nested, missing
from datalumen.operators.inspection import row_counts


def state(df: DataFrame, name: str) -> DataFrame:
    """One row: rows, columns, missing cells and duplicate rows of a table."""
    fields = [f for f in df.schema if not is_nested(f)]
    gaps = sum((missing(col(f.name), f).cast("bigint") for f in fields), F.lit(0).cast("bigint"))
    return row_counts(df, {"missing": gaps}).select(
        F.lit(name).alias("stage"), F.col("num_rows").alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"),
        "missing", F.col("duplicate_rows").alias("duplicates"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per metric with the values before and after and their difference."""
    both = state(before, "before").unionByName(state(after, "after"))
    metrics = ["rows", "columns", "missing", "duplicates"]
    long = both.select("stage", F.inline(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])))
    wide = long.groupBy("metric").agg(
        F.max(F.when(F.col("stage") == "before", F.col("value"))).alias("before_cleaning"),
        F.max(F.when(F.col("stage") == "after", F.col("value"))).alias("after_cleaning"))
    return wide.withColumn("delta", F.col("after_cleaning") - F.col("before_cleaning"))


def cleaning_summary(before: DataFrame, after: DataFrame, log: DataFrame) -> DataFrame:
    """One row: records removed and modified, cells and duplicates resolved and left, and the clean flag."""
    table = before_after(before, after).select("metric", "after_cleaning", "delta")

    def pick(metric: str, column: str):
        return F.max(F.when(F.col("metric") == metric, F.col(column)))

    modified = log.filter(F.col("action") != "removed").agg(F.coalesce(F.sum("records_affected"), F.lit(0)))
    row = table.agg(
        (-pick("rows", "delta")).alias("records_removed"),
        (-pick("missing", "delta")).alias("missing_resolved"),
        (-pick("duplicates", "delta")).alias("duplicates_resolved"),
        pick("missing", "after_cleaning").alias("remaining_missing"),
        pick("duplicates", "after_cleaning").alias("remaining_duplicates"))
    return row.withColumn("records_modified", modified.scalar()).withColumn(
        "is_fully_clean", (F.col("remaining_missing") == 0) & (F.col("remaining_duplicates") == 0))
