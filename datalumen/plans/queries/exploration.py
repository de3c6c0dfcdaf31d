"""Correlations, segments, trends, anomalies and chart data."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.operators import charts, exploration
from datalumen.operators.inspection import table_meta
from datalumen.plans.queries.cleaning import FENCES
from datalumen.plans.queries.inspection import DIRTY_COLUMNS, INSPECT, NUMBERS, union
from datalumen.plans.registry import DIRTY_CTE, Tables, query

DERIVED = ["l_quantity", "l_extendedprice", "net", "charge"]
DERIVED_CTE = """b AS (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) + 500 * l_quantity AS charge FROM lineitem)"""


def pearson_sql(columns: list[str], table: str, name: str = "pearson") -> str:
    return union([f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 4) AS {name} FROM {table}"
                  for a, b in combinations(columns, 2)])


def ranks_cte(columns: list[str], table: str) -> str:
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in columns)
    return f"r AS (SELECT {ranks} FROM {table})"


def derived(t: Tables) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select("l_quantity", "l_extendedprice", net.alias("net"),
                             (net * (1 + F.col("l_tax")) + 500 * F.col("l_quantity")).alias("charge"))


@query("corr_pearson", pearson_sql(NUMBERS, "lineitem"))
def corr_pearson(t: Tables) -> DataFrame:
    return exploration.corr_pearson(t.lineitem, NUMBERS)


@query("corr_spearman", f"WITH {ranks_cte(NUMBERS, 'lineitem')} {pearson_sql(NUMBERS, 'r', 'spearman')}")
def corr_spearman(t: Tables) -> DataFrame:
    return exploration.corr_spearman(t.lineitem, NUMBERS)


@query("corr_top_pairs", f"""
WITH {DERIVED_CTE}, {ranks_cte(DERIVED, 'b')}
SELECT p.var1, p.var2, pearson, spearman, CASE WHEN pearson > 0 THEN 'Positive' ELSE 'Negative' END AS direction,
  CASE WHEN abs(pearson) > 0.7 THEN 'Strong' WHEN abs(pearson) > 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength
FROM ({pearson_sql(DERIVED, "b")}) p JOIN ({pearson_sql(DERIVED, "r", "spearman")}) s ON p.var1 = s.var1 AND p.var2 = s.var2
WHERE abs(pearson) >= 0.2""")
def corr_top_pairs(t: Tables) -> DataFrame:
    return exploration.corr_top_pairs(derived(t), DERIVED)


SEGMENTS = union([f"""
SELECT '{c}' AS category, {c} AS segment, '{m}' AS measure, count({m}) AS "count", round(sum({m}), 2) AS "sum",
  round(avg({m}), 2) AS mean, round(stddev_samp({m}), 2) AS std, round(median({m}), 4) AS median FROM lineitem GROUP BY {c}"""
                  for c in ("l_returnflag", "l_linestatus") for m in ("l_quantity", "l_extendedprice")])
PAIRS = (["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"])


@query("segment_breakdown", SEGMENTS)
def segment_breakdown(t: Tables) -> DataFrame:
    return exploration.segment_breakdown(t.lineitem, *PAIRS)


SEGMENT_ENDS = f"""
SELECT category, measure, arg_max(segment, "sum") AS top_segment, max("sum") AS top_sum,
  arg_min(segment, "sum") AS bottom_segment, min("sum") AS bottom_sum FROM ({SEGMENTS}) GROUP BY 1, 2"""


@query("segment_top_bottom", SEGMENT_ENDS)
def segment_top_bottom(t: Tables) -> DataFrame:
    return exploration.segment_top_bottom(t.lineitem, *PAIRS)


def monthly(table: str, time: str, value: str, by: str = "") -> str:
    """Month totals with the gaps at 0, as ``(by, period, y)``."""
    keep, same = (f"{by}, ", f"s.{by} = m.{by} AND ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""
m AS (SELECT {keep}CAST(date_trunc('month', {time}) AS DATE) AS p, sum({value}) AS v FROM {table} GROUP BY ALL),
s AS (SELECT {keep}CAST(unnest(generate_series(min(p), max(p), INTERVAL 1 MONTH)) AS DATE) AS p FROM m {group}),
t AS (SELECT {f's.{by}, ' if by else ''}last_day(s.p) AS period, round(coalesce(v, 0), 2) AS y FROM s LEFT JOIN m ON {same}s.p = m.p)"""


def daily(table: str, time: str, value: str) -> str:
    return f"""
m AS (SELECT CAST({time} AS DATE) AS p, sum({value}) AS v FROM {table} GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(min(p), max(p), INTERVAL 1 DAY)) AS DATE) AS p FROM m),
t AS (SELECT s.p AS period, round(coalesce(v, 0), 2) AS y FROM s LEFT JOIN m ON s.p = m.p)"""


MONTHS = monthly("orders", "o_orderdate", "o_totalprice")


@query("trend_daily", f"WITH {daily('events', 'ts', 'value')} SELECT CAST(period AS VARCHAR) AS period, y AS value FROM t")
def trend_daily(t: Tables) -> DataFrame:
    return exploration.period_totals(t.events, "ts", ["value"]).withColumn("period", F.col("period").cast("string"))


@query("trend_monthly", f"WITH {MONTHS} SELECT CAST(period AS VARCHAR) AS period, y AS o_totalprice FROM t")
def trend_monthly(t: Tables) -> DataFrame:
    totals = exploration.period_totals(t.orders, "o_orderdate", ["o_totalprice"])
    return totals.withColumn("period", F.col("period").cast("string"))


GROWTH = f"""
WITH {MONTHS}, e AS (SELECT count(*) AS periods, arg_min(y, period) AS a, arg_max(y, period) AS z FROM t)
SELECT 'o_totalprice' AS measure, periods, a AS initial_value, z AS latest_value, round(z - a, 2) AS absolute_change,
  round(round(z - a, 2) * 100 / a, 2) AS percentage_growth FROM e"""


@query("trend_growth", GROWTH)
def trend_growth(t: Tables) -> DataFrame:
    return exploration.trend_growth(t.orders, "o_orderdate", ["o_totalprice"])


ANOMALIES = f"""
WITH {DIRTY_CTE}, {FENCES}, o AS (SELECT price FROM d, f WHERE price < lo OR price > hi)
SELECT 'price' AS "column", (SELECT count(*) FROM o) AS iqr_outlier_count,
  round((SELECT count(*) FROM o) * 100.0 / (SELECT count(price) FROM d), 2) AS iqr_outlier_pct,
  round(lo, 2) AS lower_bound, round(hi, 2) AS upper_bound,
  coalesce((SELECT string_agg(CAST(CAST(price AS DECIMAL(38,2)) AS VARCHAR), ', ' ORDER BY price DESC)
    FROM (SELECT price FROM o ORDER BY price DESC LIMIT 5)), '') AS sample_values FROM f"""


@query("anomaly_iqr", ANOMALIES)
def anomaly_iqr(t: Tables) -> DataFrame:
    return exploration.anomaly_iqr(t.dirty, ["price"])


@query("anomaly_mad", f"""
WITH {DIRTY_CTE}, m AS (SELECT median(price) AS m FROM d), a AS (SELECT median(abs(price - m)) AS a FROM d, m)
SELECT 'price' AS "column", count(price) AS valid_count, round(any_value(m), 4) AS median, round(any_value(a), 4) AS mad,
  CAST(count_if(0.6745 * abs(price - m) / a > 3.5) AS BIGINT) AS mad_outlier_count FROM d, m, a""")
def anomaly_mad(t: Tables) -> DataFrame:
    return exploration.anomaly_mad(t.dirty, ["price"])


@query("outlier_rows", f"""
WITH {DIRTY_CTE}, {FENCES} SELECT o_orderkey, round(price, 2) AS price FROM d, f WHERE price < lo OR price > hi""")
def outlier_rows(t: Tables) -> DataFrame:
    return exploration.outlier_rows(t.dirty, "price").select("o_orderkey", F.round("price", 2).alias("price"))


@query("chart_bar", union([f"""
SELECT '{f}' AS function, o_orderpriority, CAST(round({f}(o_totalprice), 2) AS DOUBLE) AS value FROM orders GROUP BY 2"""
                           for f in charts.AGGREGATES]))
def chart_bar(t: Tables) -> DataFrame:
    return charts.chart_aggs(t.orders, "o_orderpriority", "o_totalprice")


@query("trend_raw", """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, count(*) AS volume, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1""")
def trend_raw(t: Tables) -> DataFrame:
    raw = charts.trend_raw(t.orders, "o_orderdate", "o_totalprice")
    return raw.withColumn("o_orderdate", F.col("o_orderdate").cast("date").cast("string"))


@query("scatter_trendline", """
SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared
FROM lineitem GROUP BY 1 HAVING count(*) > 10""")
def scatter_trendline(t: Tables) -> DataFrame:
    fit = charts.scatter_trendline(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")
    return fit.withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 2),
                            "r_squared": F.round("r_squared", 6)})


@query("scatter_sample", """
SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500""")
def scatter_sample(t: Tables) -> DataFrame:
    return charts.scatter_sample(t.orders, "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query("box_stats", """
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS median,
  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
j AS (SELECT *, l_extendedprice AS v, l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM lineitem JOIN q USING (l_returnflag))
SELECT l_returnflag, count(*) AS n, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median,
  round(any_value(q3), 4) AS q3, min(CASE WHEN inside THEN v END) AS whisker_low,
  max(CASE WHEN inside THEN v END) AS whisker_high, CAST(count_if(NOT inside) AS BIGINT) AS outliers FROM j GROUP BY 1""")
def box_stats(t: Tables) -> DataFrame:
    box = charts.box_stats(t.lineitem, "l_returnflag", "l_extendedprice")
    return box.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("category_share", """
SELECT o_orderpriority, count(*) AS "count", round(count(*) * 100.0 / (SELECT count(*) FROM orders), 2) AS share_pct
FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""")
def category_share(t: Tables) -> DataFrame:
    return charts.category_share(t.orders, "o_orderpriority", 6)


@query("histogram", """
WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders),
c AS (SELECT least(CAST(floor((o_totalprice - lo) / w) AS BIGINT), 19) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
SELECT bins.bin, coalesce(n, 0) AS "count", round(lo + bins.bin * w, 4) AS bin_start, round(lo + bins.bin * w + w, 4) AS bin_end
FROM (SELECT unnest(range(20)) AS bin) bins CROSS JOIN e LEFT JOIN c ON c.bin = bins.bin""")
def histogram(t: Tables) -> DataFrame:
    return charts.histogram(t.orders, "o_totalprice")


def named(role: str) -> str:
    return f"""list("column" ORDER BY place) FILTER (role = '{role}')"""


def chart(name: str, kind: str, columns: str, aggregation: str, condition: str) -> str:
    return f"""SELECT '{name}' AS chart_id, '{kind}' AS chart, {columns} AS "columns", '{aggregation}' AS aggregation FROM r WHERE {condition}"""


CHART_RULES = f"""
WITH p AS (SELECT *, list_position({list(DIRTY_COLUMNS)}, "column") AS place FROM ({INSPECT})),
r AS (SELECT {named("numerical")} AS n, {named("categorical")} AS c, {named("datetime")} AS d,
  arg_min(unique_count, place) FILTER (role = 'categorical') AS levels FROM p)
""" + union([
    chart("time_series_trend", "line", "concat_ws(',', d[1], n[1])", "sum per date", "len(d) > 0 AND len(n) > 0"),
    chart("category_bar_chart", "bar", "concat_ws(',', c[1], n[1])", "sum per category", "len(c) > 0 AND len(n) > 0"),
    chart("numerical_scatter", "scatter", "concat_ws(',', n[1], n[2])", "rows", "len(n) >= 2"),
    chart("distribution_box", "box", "concat_ws(',', c[1], n[1])", "quartiles per category", "len(c) > 0 AND len(n) > 0"),
    chart("correlation_heatmap", "heatmap", "array_to_string(n, ',')", "pearson", "len(n) >= 3"),
    chart("category_donut", "donut", "c[1]", "share of rows", "len(c) > 0 AND levels <= 6")])


@query("chart_rules", CHART_RULES)
def chart_rules(t: Tables) -> DataFrame:
    return charts.recommend_charts(t.dirty, table_meta(t.dirty)).withColumn("columns", F.array_join("columns", ","))
