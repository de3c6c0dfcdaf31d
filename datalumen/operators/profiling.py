"""Profiles per column and the quality score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datalumen.functions.columns import (
    adjusted_skew, col, hits, is_text, measure, parsed_date, share, tidy,
)
from datalumen.operators.cleaning import value_counts
from datalumen.operators.inspection import duplicate_rows, quality_facts
from datalumen.operators.quantiles import quantiles


def profile_numeric(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """One row per numeric column: counts, moments, quartiles and distinct values.

    Moments, distinct counts and quartiles are three aggregations; each yields one row per column.
    ``approx`` estimates the last two.
    """
    values = {c: measure(df, c) for c in columns}
    aggs = [F.count("*").alias("_rows")]
    for i, v in enumerate(values.values()):
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"),
                 F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"), adjusted_skew(v).alias(f"skew{i}")]
    entries = []
    for i, c in enumerate(columns):
        n = F.col(f"n{i}")
        entries.append([
            F.lit(c), F.when(n == 0, "empty").otherwise("ok"), F.col("_rows"), n, F.col("_rows") - n,
            share(F.col("_rows") - n, F.col("_rows")), F.round(f"mean{i}", 4),
            F.when(n > 0, F.coalesce(F.round(F.when(n > 1, F.col(f"std{i}")), 4), F.lit(0.0))),
            F.round(f"min{i}", 4), F.round(f"max{i}", 4),
            F.when(n > 0, F.coalesce(F.round(f"skew{i}", 4), F.lit(0.0)))])
    moments = tidy(df.agg(*aggs), entries, [
        "column", "status", "count", "valid_count", "missing_count", "missing_pct", "mean", "std", "min", "max",
        "skewness"])
    quarts = quantiles(df, columns, [0.25, 0.5, 0.75], accuracy=10_000 if approx else None)
    q = [[F.lit(c), *[F.round(col(c)[k], 4) for k in range(3)], F.round(col(c)[2] - col(c)[0], 4)] for c in columns]
    distinct = F.approx_count_distinct if approx else F.count_distinct
    uniq = df.agg(*[distinct(v).alias(f"d{i}") for i, v in enumerate(values.values())])
    d = [[F.lit(c), F.col(f"d{i}")] for i, c in enumerate(columns)]
    return moments.join(F.broadcast(tidy(quarts, q, ["column", "q25", "median", "q75", "iqr"])), "column").join(
        F.broadcast(tidy(uniq, d, ["column", "unique_count"])), "column")


def profile_categorical(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """The most frequent values of each column with the totals of the column; a null is the value "nan"."""
    counts = value_counts(df, columns, null="nan")
    totals = counts.groupBy("column").agg(F.sum("n").alias("total_count"), F.count("*").alias("unique_count"))
    rare = counts.join(F.broadcast(totals), "column").groupBy("column").agg(
        hits(F.col("n") / F.col("total_count") < 0.01).alias("rare_count"))
    window = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    best = counts.withColumn("rank", F.row_number().over(window).cast("bigint")).filter(F.col("rank") <= top)
    return best.join(F.broadcast(totals), "column").join(F.broadcast(rare), "column").select(
        "column", "rank", "value", F.col("n").alias("count"), share(F.col("n"), F.col("total_count")).alias("pct"),
        "total_count", "unique_count", "rare_count")


def profile_datetime(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per date column: valid and missing values, first, last, and the whole days between them."""
    aggs = [F.count("*").alias("_rows")]
    for i, c in enumerate(columns):
        value = parsed_date(col(c)) if is_text(df.schema[c]) else col(c).cast("timestamp")
        aggs += [F.count(value).alias(f"n{i}"), F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
    entries = [
        [F.lit(c), F.col("_rows"), F.col(f"n{i}"), F.col("_rows") - F.col(f"n{i}"),
         share(F.col("_rows") - F.col(f"n{i}"), F.col("_rows")), F.col(f"lo{i}").cast("string"),
         F.col(f"hi{i}").cast("string"), F.timestamp_diff("DAY", F.col(f"lo{i}"), F.col(f"hi{i}"))]
        for i, c in enumerate(columns)
    ]
    return tidy(df.agg(*aggs), entries, [
        "column", "total_count", "valid_count", "missing_count", "missing_pct", "min_date", "max_date",
        "date_range_days"])


def describe_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of each column, unrounded."""
    aggs = []
    for i, c in enumerate(columns):
        v = measure(df, c)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    moments = tidy(df.agg(*aggs), [
        [F.lit(c), *[F.col(f"{p}{i}") for p in ("n", "m", "s", "lo", "hi")]] for i, c in enumerate(columns)
    ], ["column", "count", "mean", "std", "min", "max"])
    quarts = tidy(quantiles(df, columns, [0.25, 0.5, 0.75]), [
        [F.lit(c), *[col(c)[k] for k in range(3)]] for c in columns], ["column", "p25", "p50", "p75"])
    return moments.join(F.broadcast(quarts), "column")


def quality_score(df: DataFrame) -> DataFrame:
    """Quality from 0 to 100: a start of 100 less five capped penalties, each rounded to 2 digits."""
    columns = quality_facts(df).agg(
        F.sum("missing_count").alias("gaps"), F.sum("null_like_count").alias("holders"),
        F.sum("total_count").alias("cells"), hits(F.col("is_constant")).alias("constant"),
        F.count("pii_type").alias("pii"))
    dups = duplicate_rows(df).select("duplicate_pct")

    def penalty(amount: Column, most: float) -> Column:
        return F.round(F.least(F.lit(most), F.coalesce(amount, F.lit(0.0))), 2)

    scored = columns.select(
        penalty(F.try_divide(F.col("gaps") * 100.0, F.col("cells")) * 1.5, 30.0).alias("missing_penalty"),
        penalty(dups.scalar() * 2.0, 20.0).alias("duplicate_penalty"),
        penalty(F.col("constant") * 5.0, 15.0).alias("constant_penalty"),
        penalty(F.col("pii") * 5.0, 10.0).alias("pii_penalty"),
        penalty(F.try_divide(F.col("holders") * 100.0, F.col("cells")) * 2.0, 10.0).alias("placeholder_penalty"))
    total = sum((F.col(c) for c in scored.columns), F.lit(0.0))
    return scored.withColumn("quality_score", F.greatest(F.lit(0.0), F.round(100.0 - total, 2)))
