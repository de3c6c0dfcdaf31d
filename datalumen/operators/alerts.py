"""Threshold alerts drawn from the result tables of the other operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_QUALITY = 95.0
ALPHA = 0.05


def alert(rows: DataFrame, level: str, metric: str, subject: Column, value: Column, threshold: float) -> DataFrame:
    return rows.select(
        F.lit(level).alias("level"), F.lit(metric).alias("metric"), subject.alias("subject"),
        F.round(value.cast("double"), 4).alias("value"), F.lit(float(threshold)).alias("threshold"))


def alerts(
    quality: DataFrame | None = None, segments: DataFrame | None = None, tests: list[DataFrame] | None = None,
    growth: DataFrame | None = None, anomalies: DataFrame | None = None, returns: DataFrame | None = None,
    customers: DataFrame | None = None,
) -> DataFrame:
    """One tidy list of findings; every input is a small result table and may be left out.

    Levels: descriptive (quality, returns, repeat customers), diagnostic (segments, significant tests),
    predictive (growth) and prescriptive (outliers).
    """
    pair = F.concat_ws(" by ", "measure", "category")
    parts = []
    if quality is not None:
        low = quality.filter(F.col("quality_score") < MIN_QUALITY)
        parts.append(alert(low, "descriptive", "quality_score", F.lit("table"), F.col("quality_score"), MIN_QUALITY))
    if segments is not None:
        subject = F.concat(pair, F.lit(": "), F.col("top_segment"), F.lit(" over "), F.col("bottom_segment"))
        apart = segments.filter(F.col("top_sum") > F.col("bottom_sum"))
        parts.append(alert(apart, "diagnostic", "segment_gap", subject, F.col("top_sum") - F.col("bottom_sum"), 0))
    for test in tests or []:
        subject = pair if "measure" in test.columns else F.concat_ws(" by ", "var1", "var2")
        parts.append(alert(test.filter(F.col("p_value") < ALPHA), "diagnostic", "significant_test", subject, F.col("statistic"), ALPHA))
    if growth is not None:
        moved = growth.filter(F.col("percentage_growth") != 0)
        parts.append(alert(moved, "predictive", "growth_pct", F.col("measure"), F.col("percentage_growth"), 0))
    if anomalies is not None:
        found = anomalies.filter(F.col("iqr_outlier_count") > 0)
        parts.append(alert(found, "prescriptive", "outliers", F.col("column"), F.col("iqr_outlier_count"), 0))
    if returns is not None:
        parts.append(alert(returns.filter("return_rate > 0"), "descriptive", "return_rate", F.lit("table"), F.col("return_rate"), 0))
    if customers is not None:
        parts.append(alert(customers, "descriptive", "repeat_rate", F.lit("table"), F.col("repeat_rate"), 0))
    if not parts:
        raise ValueError("no result table given")
    return reduce(DataFrame.unionByName, parts)
