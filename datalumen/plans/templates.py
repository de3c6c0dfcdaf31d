"""The stock queries of the console as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datalumen.functions.columns import col, measure
from datalumen.operators.exploration import as_time
from datalumen.operators.ordered import framed, numbered, tiles
from datalumen.operators.quantiles import fitted_quantiles


def top_segment_summary(df: DataFrame, category: str, value: str, n: int = 10) -> DataFrame:
    """Rows, sum and mean per segment, the largest sums first."""
    v = measure(df, value)
    return df.groupBy(col(category)).agg(
        F.count("*").alias("total_records"), F.round(F.sum(v), 2).alias("total"), F.round(F.avg(v), 2).alias("average"),
    ).orderBy(F.desc("total"), col(category)).limit(n)


def count_breakdown(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(col(category)).agg(F.count("*").alias("total_records")).orderBy(
        F.desc("total_records"), col(category))


def avg_by_segment(df: DataFrame, category: str, value: str) -> DataFrame:
    return df.groupBy(col(category)).agg(F.round(F.avg(measure(df, value)), 2).alias("average")).orderBy(
        F.desc("average"), col(category))


def metric_summary(df: DataFrame, measures: list[str]) -> DataFrame:
    """Mean, minimum and maximum of the measures in one row."""
    aggs = []
    for m in measures:
        v = measure(df, m)
        aggs += [F.round(f(v), 2).alias(f"{name}_{m}") for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return df.agg(*aggs)


def running_total_trend(df: DataFrame, time: str, value: str, window: int = 7) -> DataFrame:
    """Day totals with their running total and moving average; the windows see one row per day."""
    days = df.select(as_time(df, time).cast("date").alias("day"), measure(df, value).alias("_v")).filter(
        "day IS NOT NULL").groupBy("day").agg(F.round(F.sum("_v"), 2).alias("daily"))
    order = Window.orderBy("day")
    return days.select(
        "day", "daily",
        F.round(F.sum("daily").over(order.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("cumulative"),
        F.round(F.avg("daily").over(order.rowsBetween(1 - window, 0)), 2).alias(f"moving_avg_{window}"))


def quartile_ntile(df: DataFrame, value: str, key: list[str], n: int = 4) -> DataFrame:
    """Every row with its quarter by descending value; ties are broken by the key."""
    return tiles(df, n, [col(value).desc(), *[col(k).asc() for k in key]], "quartile")


def quartile_cutpoints(df: DataFrame, value: str) -> DataFrame:
    """Every row with its quarter by the quartiles of the value: equal values share a quarter, and no sort is needed."""
    q = fitted_quantiles(df, [value], [0.25, 0.5, 0.75])[value]
    v = measure(df, value)
    place = F.when(v > F.lit(q[2]), 1).when(v > F.lit(q[1]), 2).when(v > F.lit(q[0]), 3).otherwise(4)
    return df.withColumn("quartile", F.when(v.isNotNull(), place).cast("bigint"))


def running_total(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """Row position and running total per group, for groups of any size."""
    return numbered(df, by, order, "position", {"running": value})


def neighbours(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """The value of the row before and after each row of its group, and the mean of seven rows."""
    return framed(df, by, order, {
        "previous": lambda w: F.lag(col(value)).over(w), "following": lambda w: F.lead(col(value)).over(w),
        "moving_avg": lambda w: F.avg(col(value)).over(w.rowsBetween(-6, 0)),
    }, before=6, after=1)
