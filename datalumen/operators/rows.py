"""Row filters and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datalumen.functions.columns import col

LISTED = 1000


def slice_rows(df: DataFrame, category: str, values: list) -> DataFrame:
    """Rows whose category is among the values; no values means all rows.

    Long lists become a broadcast semi join instead of a huge expression.
    """
    if not values:
        return df
    if len(values) <= LISTED:
        return df.filter(col(category).isin(values))
    kind = df.schema[category].dataType.simpleString()
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"_v {kind}").distinct()
    wanted = F.broadcast(wanted) if len(values) <= 1_000_000 else wanted
    return df.join(wanted, col(category) == F.col("_v"), "left_semi")


def sample_head(df: DataFrame, order: list[Column], columns: list[str], n: int = 20) -> DataFrame:
    """The first n rows by a given order as lines of CSV text."""
    head = df.orderBy(*order).limit(n)
    return head.select(F.to_csv(F.struct(*[col(c) for c in columns])).alias("line"))


def top_rows(df: DataFrame, measure: str, ties: list[str], n: int = 20) -> DataFrame:
    """The rows with the largest values; ties are broken by further columns."""
    return df.orderBy(col(measure).desc(), *[col(c) for c in ties]).limit(n)
