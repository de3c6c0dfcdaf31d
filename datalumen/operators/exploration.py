"""Correlations, segments, time trends and anomalies."""

from __future__ import annotations

from itertools import combinations
from math import isnan

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datalumen.functions.columns import any_of, col, hits, is_text, join_null_safe, measure, parsed_date, share, tidy
from datalumen.operators.cleaning import outside
from datalumen.operators.ordered import average_ranks
from datalumen.operators.quantiles import fitted_quantiles, quantiles

WIDE = 20
PAIR = ["var1", "var2"]


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The numeric columns as doubles, rows with a gap left out."""
    numbers = df.select(*[measure(df, c).alias(c) for c in columns])
    return numbers.filter(~any_of([col(c).isNull() for c in columns]))


def _pair_correlations(numbers: DataFrame, columns: list[str], name: str) -> DataFrame:
    pairs = list(combinations(columns, 2))
    if len(columns) <= WIDE:
        enough = F.count("*") >= 3

        def pearson(a: str, b: str) -> Column:
            """Null where a column does not vary."""
            return F.try_divide(F.covar_pop(col(a), col(b)), F.stddev_pop(col(a)) * F.stddev_pop(col(b)))

        wide = numbers.agg(*[F.when(enough, pearson(a, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
        entries = [[F.lit(a), F.lit(b), F.round(F.col(f"r{i}"), 4)] for i, (a, b) in enumerate(pairs)]
        return tidy(wide, entries, [*PAIR, name])
    # Many columns: one Gram matrix instead of hundreds of pair aggregates; its size is columns squared.
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    rows = [(a, b, None) for a, b in pairs]
    if numbers.limit(3).count() == 3:
        named = {c: f"_{i}" for i, c in enumerate(columns)}
        plain = numbers.select(*[col(c).alias(n) for c, n in named.items()])
        vectors = VectorAssembler(inputCols=list(named.values()), outputCol="_v").transform(plain).select("_v")
        matrix = Correlation.corr(vectors, "_v", "pearson").first()[0].toArray()
        found = {(columns[i], columns[j]): float(matrix[i, j]) for i, j in combinations(range(len(columns)), 2)}
        rows = [(*pair, None if isnan(r) else r) for pair, r in found.items()]
    out = numbers.sparkSession.createDataFrame(rows, f"var1 string, var2 string, {name} double")
    return out.withColumn(name, F.round(name, 4))


def corr_pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair, on the rows complete in all columns, in one pass."""
    return _pair_correlations(complete_rows(df, columns), columns, "pearson")


def corr_spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation of every pair; ties take their average rank."""
    return _pair_correlations(average_ranks(complete_rows(df, columns), columns), columns, "spearman")


def corr_top_pairs(df: DataFrame, columns: list[str], threshold: float = 0.2) -> DataFrame:
    """Pairs with a correlation of at least the threshold, strongest first."""
    both = corr_pearson(df, columns).join(F.broadcast(corr_spearman(df, columns)), PAIR)
    size = F.abs("pearson")
    return both.filter(size >= threshold).select(
        *PAIR, "pearson", "spearman",
        F.when(F.col("pearson") > 0, "Positive").otherwise("Negative").alias("direction"),
        F.when(size > 0.7, "Strong").when(size > 0.4, "Moderate").otherwise("Weak").alias("strength"),
    ).orderBy(F.desc(F.abs("pearson")), *PAIR)


def _segments(df: DataFrame, categories: list[str], measures: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("category"), col(c).cast("string").alias("segment")) for c in categories]
    values = [measure(df, m).alias(f"_m{i}") for i, m in enumerate(measures)]
    return df.select(F.inline(F.array(*cells)), *values).filter("segment IS NOT NULL")


def segment_breakdown(df: DataFrame, categories: list[str], measures: list[str], caps: int | None = None) -> DataFrame:
    """Count, sum, mean, deviation and median of each measure per segment; ``caps`` keeps only the first columns of each kind."""
    categories, measures = categories[:caps], measures[:caps]
    rows = _segments(df, categories, measures)
    keys = ["category", "segment"]
    aggs = []
    for i in range(len(measures)):
        v = F.col(f"_m{i}")
        aggs += [F.count(v).alias(f"n{i}"), F.sum(v).alias(f"s{i}"), F.avg(v).alias(f"a{i}"),
                 F.stddev_samp(v).alias(f"d{i}")]
    stats = rows.groupBy(*keys).agg(*aggs)
    medians = quantiles(rows, [f"_m{i}" for i in range(len(measures))], [0.5], keys)
    both = join_null_safe(stats, medians, keys)
    entries = [
        F.struct(F.lit(m).alias("measure"), F.col(f"n{i}").alias("count"),
                 F.round(F.coalesce(F.col(f"s{i}"), F.lit(0.0)), 2).alias("sum"), F.round(F.col(f"a{i}"), 2).alias("mean"),
                 F.coalesce(F.round(F.col(f"d{i}"), 2), F.lit(0.0)).alias("std"),
                 F.round(F.col(f"_m{i}")[0], 4).alias("median"))
        for i, m in enumerate(measures)
    ]
    return both.select(*keys, F.inline(F.array(*entries))).orderBy("category", "measure", F.desc("sum"), "segment")


def segment_top_bottom(df: DataFrame, categories: list[str], measures: list[str], caps: int | None = None) -> DataFrame:
    """The segments with the highest and the lowest sum for each pair of columns."""
    categories, measures = categories[:caps], measures[:caps]
    sums = _segments(df, categories, measures).groupBy("category", "segment").agg(
        *[F.sum(f"_m{i}").alias(f"s{i}") for i in range(len(measures))])
    long = sums.select("category", "segment", F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.round(F.coalesce(F.col(f"s{i}"), F.lit(0.0)), 2).alias("sum"))
        for i, m in enumerate(measures)])))
    return long.groupBy("category", "measure").agg(
        F.min_by("segment", F.struct(-F.col("sum"), "segment")).alias("top_segment"), F.max("sum").alias("top_sum"),
        F.max_by("segment", F.struct(-F.col("sum"), "segment")).alias("bottom_segment"),
        F.min("sum").alias("bottom_sum"))


def as_time(df: DataFrame, name: str) -> Column:
    """A date column, or dates held as text, as timestamp."""
    return parsed_date(col(name)) if is_text(df.schema[name]) else col(name).cast("timestamp")


def pick_grain(df: DataFrame, time: str) -> str:
    """``month`` when the dates span more than 60 whole days, else ``day``."""
    t = as_time(df, time)
    days = df.agg(F.timestamp_diff("DAY", F.min(t), F.max(t))).first()[0]
    return "month" if days is not None and days > 60 else "day"


def period_totals(
    df: DataFrame, time: str, measures: list[str], grain: str | None = None, by: list[str] | None = None
) -> DataFrame:
    """Sums per day, or per month labelled by its last day; periods without rows are 0.

    Only the totals are spread over the calendar, so the frame that fills the gaps has one row per
    period and group, however large the table is.
    """
    by = by or []
    grain = grain or pick_grain(df, time)
    keys = [col(k) for k in by]
    start = F.trunc(as_time(df, time), "month") if grain == "month" else as_time(df, time).cast("date")
    rows = df.select(*keys, start.alias("_start"), *[measure(df, m).alias(m) for m in measures])
    totals = rows.filter("_start IS NOT NULL").groupBy(*keys, "_start").agg(*[F.sum(col(m)).alias(m) for m in measures])
    step = F.expr("INTERVAL 1 MONTH") if grain == "month" else F.expr("INTERVAL 1 DAY")
    ends = [F.min("_start").alias("_lo"), F.max("_start").alias("_hi")]
    spans = totals.groupBy(*keys).agg(*ends) if by else totals.agg(*ends)
    spine = spans.select(*keys, F.explode(F.sequence("_lo", "_hi", step)).alias("_start"))
    filled = join_null_safe(spine, totals, [*by, "_start"], "left")
    label = F.last_day("_start") if grain == "month" else F.col("_start")
    return filled.select(
        *keys, label.alias("period"), *[F.round(F.coalesce(col(m), F.lit(0.0)), 2).alias(m) for m in measures])


def trend_growth(df: DataFrame, time: str, measures: list[str], grain: str | None = None) -> DataFrame:
    """First and last period of each measure, with absolute and percent change."""
    totals = period_totals(df, time, measures, grain)
    long = totals.select("period", F.inline(F.array(
        *[F.struct(F.lit(m).alias("measure"), col(m).alias("value")) for m in measures])))
    ends = long.groupBy("measure").agg(
        F.count("*").alias("periods"), F.min_by("value", "period").alias("initial_value"),
        F.max_by("value", "period").alias("latest_value"))
    change = F.round(F.col("latest_value") - F.col("initial_value"), 2)
    return ends.filter("periods >= 2").withColumn("absolute_change", change).withColumn(
        "percentage_growth", share(F.col("absolute_change"), F.nullif(F.col("initial_value"), F.lit(0.0))))


def _two_digits(v: Column) -> Column:
    return F.coalesce(F.round(v, 2).try_cast("decimal(38,2)").cast("string"), v.cast("string"))


def anomaly_iqr(df: DataFrame, columns: list[str], samples: int = 5) -> DataFrame:
    """Values beyond 1.5 quartile distances per column, with the largest of them as samples."""
    quarts = fitted_quantiles(df, columns, [0.25, 0.75])
    bounds = {c: (q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])) for c, q in quarts.items() if q}
    if not bounds:
        schema = ("column string, iqr_outlier_count bigint, iqr_outlier_pct double, lower_bound double, "
                  "upper_bound double, sample_values string")
        return df.sparkSession.createDataFrame([], schema)
    values = {c: measure(df, c) for c in bounds}
    wide = df.agg(*[e for i, (c, (lo, hi)) in enumerate(bounds.items()) for e in (
        F.count(values[c]).alias(f"n{i}"), hits(outside(values[c], lo, hi)).alias(f"o{i}"))])
    table = tidy(wide, [
        [F.lit(c), F.col(f"n{i}"), F.col(f"o{i}"), share(F.col(f"o{i}"), F.col(f"n{i}")),
         F.round(F.lit(lo), 2), F.round(F.lit(hi), 2)] for i, (c, (lo, hi)) in enumerate(bounds.items())],
        ["column", "valid_count", "iqr_outlier_count", "iqr_outlier_pct", "lower_bound", "upper_bound"])
    found = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.when(outside(values[c], lo, hi), values[c]).alias("value"))
        for c, (lo, hi) in bounds.items()]))).filter("value IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("value")))
    top = found.withColumn("_rn", place).filter(F.col("_rn") <= samples).groupBy("column").agg(
        F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list("value"))), _two_digits), ", ").alias("sample_values"))
    return table.filter("valid_count >= 5").join(F.broadcast(top), "column", "left").drop("valid_count").withColumn(
        "sample_values", F.coalesce("sample_values", F.lit("")))


def outlier_rows(df: DataFrame, column: str) -> DataFrame:
    """The rows whose value lies beyond 1.5 quartile distances."""
    low, high = fitted_quantiles(df, [column], [0.25, 0.75])[column]
    reach = 1.5 * (high - low)
    return df.filter(outside(measure(df, column), low - reach, high + reach))


def anomaly_mad(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values with a modified z-score above 3.5 per column; none when the median deviation is 0."""
    rows = df.count()
    centres = {c: q[0] for c, q in fitted_quantiles(df, columns, [0.5], known=rows).items() if q}
    spread = df.select(*[F.abs(measure(df, c) - F.lit(m)).alias(c) for c, m in centres.items()])
    mads = {c: q[0] for c, q in fitted_quantiles(spread, list(centres), [0.5], known=rows).items()}
    aggs, entries = [], []
    for i, c in enumerate(centres):
        score = F.lit(0.6745) * col(c) / F.lit(mads[c]) if mads[c] else F.lit(0.0)
        aggs += [F.count(col(c)).alias(f"n{i}"), hits(score > 3.5).alias(f"o{i}")]
        entries.append([F.lit(c), F.col(f"n{i}"), F.round(F.lit(centres[c]), 4), F.round(F.lit(mads[c]), 4), F.col(f"o{i}")])
    return tidy(spread.agg(*aggs), entries, ["column", "valid_count", "median", "mad", "mad_outlier_count"])
