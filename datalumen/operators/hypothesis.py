"""Hypothesis tests from group statistics: one aggregation, then a few rows of arithmetic."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datalumen.functions.columns import col, measure
from datalumen.functions.distributions import chi2_p_value, f_p_value, t_critical, t_p_value

ALPHA = 0.05


def group_moments(df: DataFrame, categories: list[str], measures: list[str]) -> DataFrame:
    """``(category, level, measure, n, mean, var)`` for all pairs of columns from one scan; null levels are left out."""
    cells = [F.struct(F.lit(c).alias("category"), col(c).cast("string").alias("level")) for c in categories]
    rows = df.select(F.inline(F.array(*cells)), *[measure(df, m).alias(f"_m{i}") for i, m in enumerate(measures)])
    aggs = []
    for i in range(len(measures)):
        v = F.col(f"_m{i}")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.var_samp(v).alias(f"v{i}")]
    wide = rows.filter("level IS NOT NULL").groupBy("category", "level").agg(*aggs)
    return wide.select("category", "level", F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("mean"),
                 F.col(f"v{i}").alias("var")) for i, m in enumerate(measures)])))


def welch_t(df: DataFrame, categories: list[str], measures: list[str]) -> DataFrame:
    """Welch's t-test for every category with two levels and every measure, levels in ascending order."""
    sides = group_moments(df, categories, measures).groupBy("category", "measure").agg(
        F.count("*").alias("levels"), F.min("n").alias("fewest"),
        *[f(c, "level").alias(f"{c}_{k}") for k, f in ((1, F.min_by), (2, F.max_by)) for c in ("level", "n", "mean", "var")])
    a, b = F.col("var_1") / F.col("n_1"), F.col("var_2") / F.col("n_2")
    t = F.try_divide(F.col("mean_1") - F.col("mean_2"), F.sqrt(a + b))
    freedom = F.try_divide((a + b) * (a + b), a * a / (F.col("n_1") - 1) + b * b / (F.col("n_2") - 1))
    tested = sides.filter("levels = 2 AND fewest >= 3").select(
        "category", "measure", F.col("level_1").alias("group_1"), F.round("mean_1", 2).alias("mean_1"), "n_1",
        F.col("level_2").alias("group_2"), F.round("mean_2", 2).alias("mean_2"), "n_2",
        t.alias("statistic"), freedom.alias("df"))
    return tested.withColumn("p_value", t_p_value(F.col("statistic"), F.col("df"))).withColumn(
        "significant", F.col("p_value") < ALPHA)


def chi_square(df: DataFrame, categories: list[str], max_levels: int | None = None) -> DataFrame:
    """Chi-square test of independence for each pair of columns, with Yates' correction for 2 x 2 tables.

    Only the cells that occur are kept; the others enter through the expected counts that are left over.
    ``max_levels`` skips the columns with more levels, which the caller has to ask for.
    """
    if max_levels is not None:
        counts = df.agg(*[F.approx_count_distinct(col(c)).alias(c) for c in categories]).first()
        categories = [c for c in categories if counts[c] <= max_levels]
    pairs = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), col(a).cast("string").alias("a"),
                      col(b).cast("string").alias("b")) for a, b in combinations(categories, 2)]
    schema = "var1 string, var2 string, rows bigint, cols bigint, statistic double, df bigint, p_value double, significant boolean"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    key = ["var1", "var2"]
    cells = df.select(F.inline(F.array(*pairs))).filter("a IS NOT NULL AND b IS NOT NULL").groupBy(
        *key, "a", "b").agg(F.count("*").alias("o"))
    rows = cells.groupBy(*key, "a").agg(F.sum("o").alias("row_sum"))
    cols = cells.groupBy(*key, "b").agg(F.sum("o").alias("col_sum"))
    sizes = rows.groupBy(*key).agg(
        F.count("*").alias("rows"), F.sum("row_sum").alias("total"), F.sum(1.0 / F.col("row_sum")).alias("row_inv"))
    widths = cols.groupBy(*key).agg(F.count("*").alias("cols"), F.sum(1.0 / F.col("col_sum")).alias("col_inv"))
    sizes = sizes.join(F.broadcast(widths), key)
    joined = cells.join(rows, [*key, "a"]).join(cols, [*key, "b"]).join(F.broadcast(sizes), key)
    expected = F.col("row_sum").cast("double") * F.col("col_sum") / F.col("total")
    gap = F.col("o") - expected
    summed = joined.groupBy(*key).agg(
        F.first("rows").alias("rows"), F.first("cols").alias("cols"), F.first("total").alias("total"),
        F.sum(gap * gap / expected).alias("part"), F.sum(expected).alias("covered"), F.max(F.abs(gap)).alias("gap"),
        F.first(F.col("row_inv") * F.col("col_inv")).alias("inv"))
    # A cell that never occurs adds its expected count; all four gaps of a 2 x 2 table are equal.
    plain = F.col("part") + F.col("total") - F.col("covered")
    kept = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    yates = kept * kept * F.col("total") * F.col("inv")
    freedom = (F.col("rows") - 1) * (F.col("cols") - 1)
    tested = summed.filter("rows >= 2 AND cols >= 2").select(
        *key, "rows", "cols", F.when(freedom == 1, yates).otherwise(plain).alias("statistic"), freedom.alias("df"))
    return tested.withColumn("p_value", chi2_p_value(F.col("statistic"), F.col("df"))).withColumn(
        "significant", F.col("p_value") < ALPHA)


def anova_f(df: DataFrame, categories: list[str], measures: list[str], caps: int | None = None) -> DataFrame:
    """One-way analysis of variance for the categories with 3 to 10 levels; groups below 3 values are left out."""
    pair = ["category", "measure"]
    moments = group_moments(df, categories[:caps], measures[:caps])
    levels = moments.groupBy(*pair).agg(F.count("*").alias("levels")).filter("levels BETWEEN 3 AND 10")
    usable = moments.join(F.broadcast(levels), pair).filter("n >= 3")
    # At most ten rows per window, by the filter above.
    window = Window.partitionBy(*pair)
    grand = F.sum(F.col("n") * F.col("mean")).over(window) / F.sum("n").over(window)
    centred = usable.withColumn("grand", grand)
    off = F.col("mean") - F.col("grand")
    sums = centred.groupBy(*pair).agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * off * off).alias("between"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("within")).filter("groups > 2")
    tested = sums.select(
        *pair, "groups", "n",
        F.try_divide(F.col("between") / (F.col("groups") - 1), F.col("within") / (F.col("n") - F.col("groups"))).alias("statistic"),
        (F.col("groups") - 1).alias("df_between"), (F.col("n") - F.col("groups")).alias("df_within"))
    p = f_p_value(F.col("statistic"), F.col("df_between"), F.col("df_within"))
    return tested.withColumn("p_value", p).withColumn("significant", F.col("p_value") < ALPHA)


def mean_ci(df: DataFrame, columns: list[str], confidence: float = 0.95) -> DataFrame:
    """Mean with its t confidence interval per column; columns with fewer than two values are left out."""
    aggs, entries = [], []
    for i, c in enumerate(columns):
        v = measure(df, c)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}")]
        entries.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("mean"),
                                (F.col(f"s{i}") / F.sqrt(F.col(f"n{i}"))).alias("sem")))
    rows = df.agg(*aggs).select(F.inline(F.array(*entries))).filter("n >= 2")
    half = rows.withColumn("margin", F.col("sem") * t_critical(F.lit((1 + confidence) / 2), F.col("n") - 1))
    return half.select(
        "column", "n", F.round("mean", 4).alias("mean"), F.lit(confidence).alias("confidence_level"),
        F.round("margin", 4).alias("margin_of_error"), F.round(F.col("mean") - F.col("margin"), 4).alias("ci_lower"),
        F.round(F.col("mean") + F.col("margin"), 4).alias("ci_upper"))
