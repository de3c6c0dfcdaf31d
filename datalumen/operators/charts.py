"""The aggregates behind the charts, and the rules that pick a chart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.functions.columns import col, hits, join_null_safe, measure, share
from datalumen.operators.inspection import TableMeta
from datalumen.operators.quantiles import BRACKETS, quantiles
from datalumen.session import sent

AGGREGATES = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}


def chart_agg(df: DataFrame, x: str, y: str | None = None, function: str = "sum") -> DataFrame:
    """One value per x; without y, the number of rows."""
    if y is None:
        return df.groupBy(col(x)).agg(F.count("*").alias("value")).orderBy(F.desc("value"), col(x))
    value = AGGREGATES[function](measure(df, y))
    value = value if function == "count" else F.round(value, 2)
    return df.groupBy(col(x)).agg(value.alias("value")).orderBy(F.desc("value"), col(x))


def chart_aggs(df: DataFrame, x: str, y: str) -> DataFrame:
    """``function, x, value`` of all functions, in one pass."""
    value = measure(df, y)
    found = df.groupBy(col(x)).agg(*[f(value).cast("double").alias(f"_{name}") for name, f in AGGREGATES.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("function"), F.round(F.col(f"_{name}"), 2).alias("value")) for name in AGGREGATES])
    return found.select(col(x), F.inline(rows)).select("function", col(x), "value")


def trend_raw(df: DataFrame, time: str, value: str) -> DataFrame:
    """Rows and sum per distinct timestamp."""
    return df.filter(col(time).isNotNull()).groupBy(col(time)).agg(
        F.count("*").alias("volume"), F.round(F.sum(measure(df, value)), 2).alias("total")).orderBy(col(time))


def scatter_trendline(df: DataFrame, x: str, y: str, color: str) -> DataFrame:
    """The least-squares line per colour group, for groups of more than ten rows."""
    a, b = measure(df, x), measure(df, y)
    fits = df.groupBy(col(color)).agg(
        hits(a.isNotNull() & b.isNotNull()).alias("n"), F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r_squared"))
    return fits.filter("n > 10")


def scatter_sample(df: DataFrame, key: str, columns: list[str], points: int = 500) -> DataFrame:
    """A fixed number of points for drawing, spread evenly by a hash of the key and the same on every run."""
    mark = F.md5(col(key).cast("string"))
    return df.select(col(key), *[col(c) for c in columns]).orderBy(mark, col(key)).limit(points)


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers inside the fences and outlier count per group."""
    rows = df.select(col(group).alias(group), measure(df, value).alias("_v")).filter("_v IS NOT NULL")
    quarts = quantiles(rows, ["_v"], [0.25, 0.5, 0.75], [group]).select(
        col(group), F.col("_v")[0].alias("q1"), F.col("_v")[1].alias("median"), F.col("_v")[2].alias("q3"))
    both = join_null_safe(rows, sent(quarts, BRACKETS), [group])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    return both.groupBy(col(group)).agg(
        F.count("*").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"), F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        hits(~inside).alias("outliers"))


def category_share(df: DataFrame, category: str, top: int | None = None) -> DataFrame:
    """Rows per category and their share of all rows with a category."""
    counts = df.filter(col(category).isNotNull()).groupBy(col(category)).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    out = counts.withColumn("share_pct", share(F.col("count"), total)).orderBy(F.desc("count"), col(category))
    return out.limit(top) if top else out


def histogram(df: DataFrame, value: str, bins: int = 20, color: str | None = None) -> DataFrame:
    """Rows per equal-width bin between the smallest and the largest value; empty bins are kept at 0 without colours."""
    v = measure(df, value)
    low, high = df.agg(F.min(v), F.max(v)).first()
    if low is None:
        raise ValueError(f"{value} holds no number")
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    keys = [place.alias("bin")] + ([col(color).alias(color)] if color else [])
    counts = df.filter(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("count"))
    if not color:
        spine = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
        counts = spine.join(F.broadcast(counts), "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    edge = F.lit(low) + F.col("bin") * F.lit(width)
    return counts.withColumn("bin_start", F.round(edge, 4)).withColumn("bin_end", F.round(edge + F.lit(width), 4))


def recommend_charts(df: DataFrame, meta: TableMeta) -> DataFrame:
    """Charts that fit the roles of the columns, with the columns and the aggregation they need."""
    numbers, categories, dates = meta.numerical_columns, meta.categorical_columns, meta.datetime_columns
    rows = []
    if dates and numbers:
        rows.append(("time_series_trend", "line", [dates[0], numbers[0]], "sum per date"))
    if categories and numbers:
        rows.append(("category_bar_chart", "bar", [categories[0], numbers[0]], "sum per category"))
    if len(numbers) >= 2:
        rows.append(("numerical_scatter", "scatter", list(numbers[:2]), "rows"))
    if categories and numbers:
        rows.append(("distribution_box", "box", [categories[0], numbers[0]], "quartiles per category"))
    if len(numbers) >= 3:
        rows.append(("correlation_heatmap", "heatmap", list(numbers), "pearson"))
    if categories and meta.unique_counts.get(categories[0], 7) <= 6:
        rows.append(("category_donut", "donut", [categories[0]], "share of rows"))
    return df.sparkSession.createDataFrame(rows, "chart_id string, chart string, columns array<string>, aggregation string")
