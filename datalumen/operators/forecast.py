"""Linear trend forecasts over day or month totals, for one series or for one per segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datalumen.functions.columns import col, measure
from datalumen.functions.distributions import t_p_value
from datalumen.operators.exploration import as_time, period_totals, pick_grain


def _series(df: DataFrame, time: str, value: str, grain: str, by: list[str]) -> DataFrame:
    """Period totals with their index 0, 1, ... per group; gaps count as 0, so the index follows the calendar."""
    rows = df.filter(as_time(df, time).isNotNull() & measure(df, value).isNotNull())
    totals = period_totals(rows, time, [value], grain, by).withColumnRenamed(value, "y")
    # The calendar bounds a group here: one row per day or month.
    order = Window.partitionBy(*[col(k) for k in by]).orderBy("period")
    return totals.withColumn("x", (F.row_number().over(order) - 1).cast("double"))


def _fit(series: DataFrame, by: list[str]) -> DataFrame:
    y, x = F.col("y"), F.col("x")
    fit = series.groupBy(*[col(k) for k in by]).agg(
        F.count("*").alias("n"), F.max("period").alias("last_period"), F.max("x").alias("last_x"), F.avg(y).alias("mean"),
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    # A flat series has no spread to explain: its slope is exact and R2 is 0.
    fit = fit.withColumn("r2", F.coalesce(F.when(F.col("syy") > 0, F.col("r2")), F.lit(0.0)))
    left = F.greatest(F.lit(0.0), 1.0 - F.col("r2"))
    error = F.sqrt(F.try_divide(left * F.col("syy") / F.col("sxx"), F.col("n") - 2))
    return fit.withColumn("std_err", error)


def _enough(df: DataFrame, time: str, value: str, by: list[str]) -> DataFrame:
    rows = df.filter(as_time(df, time).isNotNull() & measure(df, value).isNotNull())
    return rows.groupBy(*[col(k) for k in by]).agg(F.count("*").alias("_rows")).filter("_rows >= 4").drop("_rows")


def forecast(
    df: DataFrame, time: str, value: str, periods: int = 6, grain: str | None = None, by: list[str] | None = None
) -> DataFrame:
    """The next periods with a band of 1.96 standard errors of the slope, never below 0.

    Series with fewer than four rows yield nothing. With ``by`` every segment gets its own line; all of
    them are fitted by the same aggregation.
    """
    by = by or []
    grain = grain or pick_grain(df, time)
    fit = _fit(_series(df, time, value, grain, by), by)
    if by:
        fit = fit.join(_enough(df, time, value, by), by, "left_semi")
    elif df.filter(as_time(df, time).isNotNull() & measure(df, value).isNotNull()).limit(4).count() < 4:
        fit = fit.limit(0)
    ahead = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    x = F.col("last_x") + F.col("step")
    raw = F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * x)
    margin = F.coalesce(F.lit(1.96) * F.col("std_err") * F.sqrt(x), raw * 0.1)
    date = F.add_months("last_period", F.col("step")) if grain == "month" else F.date_add("last_period", F.col("step"))
    return ahead.select(
        *[col(k) for k in by], "step", date.alias("period"), F.round(raw, 2).alias("forecast"),
        F.round(F.greatest(F.lit(0.0), raw - margin), 2).alias("ci_lower"), F.round(raw + margin, 2).alias("ci_upper"))


def forecast_summary(
    df: DataFrame, time: str, value: str, grain: str | None = None, by: list[str] | None = None
) -> DataFrame:
    """Direction, slope as a percent of the mean, fit and p-value of the trend line."""
    by = by or []
    grain = grain or pick_grain(df, time)
    fit = _fit(_series(df, time, value, grain, by), by)
    growth: Column = F.coalesce(F.round(F.try_divide(F.col("slope") * 100.0, F.nullif(F.col("mean"), F.lit(0.0))), 2), F.lit(0.0))
    t = F.try_divide(F.col("slope"), F.nullif(F.col("std_err"), F.lit(0.0)))
    return fit.select(
        *[col(k) for k in by], F.lit("Monthly" if grain == "month" else "Daily").alias("granularity"),
        F.col("n").alias("periods"),
        F.when(F.col("slope") > 0, "Upward").otherwise("Downward").alias("trend_direction"),
        growth.alias("slope_growth_pct"), F.round("r2", 4).alias("r_squared"),
        t_p_value(t, F.col("n") - 2).alias("p_value"))
