"""Hypothesis tests, business figures, forecasts and baseline models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.operators import forecast, hypothesis, kpi, modeling
from datalumen.plans.queries.exploration import MONTHS, daily, monthly
from datalumen.plans.queries.inspection import NUMBERS, union
from datalumen.plans.registry import Tables, query


def t_tail(source: str, t: str, df: str, keep: str) -> str:
    """Two-sided t probability by Simpson's rule over the density, for the rows of a CTE."""
    return f"""
SELECT {keep}, round(1 - 2 * any_value(c) * any_value(h) / 3 * sum(
    CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(i * h, 2) / v, -(v + 1) / 2)), 6) AS p_value
FROM (SELECT *, unnest(range(2001)) AS i FROM (
  SELECT *, abs({t}) / 2000 AS h, CAST({df} AS DOUBLE) AS v,
    exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) AS c FROM {source}))
GROUP BY ALL"""


@query("welch_t", f"""
WITH m AS ({union([f"""
  SELECT '{m}' AS measure, l_linestatus AS g, count({m}) AS n, avg({m}) AS a, var_samp({m}) AS v FROM lineitem GROUP BY 2"""
                   for m in NUMBERS])}),
w AS (SELECT x.measure, x.g AS group_1, x.a AS a1, x.n AS n_1, y.g AS group_2, y.a AS a2, y.n AS n_2,
  (x.a - y.a) / sqrt(x.v / x.n + y.v / y.n) AS t,
  pow(x.v / x.n + y.v / y.n, 2) / (pow(x.v / x.n, 2) / (x.n - 1) + pow(y.v / y.n, 2) / (y.n - 1)) AS f
  FROM m x JOIN m y ON x.measure = y.measure AND x.g < y.g),
p AS ({t_tail("w", "t", "f", "measure, group_1, a1, n_1, group_2, a2, n_2, t, f")})
SELECT 'l_linestatus' AS category, measure, group_1, round(a1, 2) AS mean_1, n_1, group_2, round(a2, 2) AS mean_2, n_2,
  round(t, 4) AS statistic, round(f, 3) AS df, p_value, p_value < 0.05 AS significant FROM p""")
def welch_t(t: Tables) -> DataFrame:
    out = hypothesis.welch_t(t.lineitem, ["l_linestatus", "l_returnflag"], NUMBERS)
    return out.withColumns({"statistic": F.round("statistic", 4), "df": F.round("df", 3), "p_value": F.round("p_value", 6)})


def chi_sql(table: str, a: str, b: str) -> str:
    return f"""
c AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS n FROM {table} GROUP BY 1, 2),
ra AS (SELECT a, sum(n) AS s FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS s FROM c GROUP BY 1),
g AS (SELECT coalesce(c.n, 0) AS o, ra.s * rb.s * 1.0 / (SELECT sum(n) FROM c) AS e
  FROM ra CROSS JOIN rb LEFT JOIN c ON c.a = ra.a AND c.b = rb.b),
k AS (SELECT (SELECT count(*) FROM ra) AS rows, (SELECT count(*) FROM rb) AS cols)"""


# The tail of a chi-square with 8 degrees of freedom has a closed form.
CHI_TAIL_8 = "exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6)"


@query("chi_square", f"""
WITH {chi_sql("orders", "o_orderstatus", "o_orderpriority")}, s AS (SELECT sum(pow(o - e, 2) / e) AS x FROM g)
SELECT 'o_orderstatus' AS var1, 'o_orderpriority' AS var2, rows, cols, round(x, 4) AS statistic, (rows - 1) * (cols - 1) AS df,
  round({CHI_TAIL_8}, 6) AS p_value, {CHI_TAIL_8} < 0.05 AS significant FROM s, k""")
def chi_square(t: Tables) -> DataFrame:
    out = hypothesis.chi_square(t.orders, ["o_orderstatus", "o_orderpriority"])
    return out.withColumns({"statistic": F.round("statistic", 4), "p_value": F.round("p_value", 6)})


CHI_YATES = f"""
WITH {chi_sql("labels", "quality", "toxic")}, s AS (SELECT sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) AS x FROM g)
SELECT 'quality' AS var1, 'toxic' AS var2, rows, cols, round(x, 4) AS statistic, (rows - 1) * (cols - 1) AS df FROM s, k"""


@query("chi_square_yates", CHI_YATES)
def chi_square_yates(t: Tables) -> DataFrame:
    out = hypothesis.chi_square(t.labels, ["quality", "toxic"])
    return out.withColumn("statistic", F.round("statistic", 4)).drop("p_value", "significant")


@query("anova_f", f"""
WITH g AS ({union([f"""
  SELECT '{m}' AS measure, l_returnflag AS g, count({m}) AS n, avg({m}) AS a, var_samp({m}) AS v FROM lineitem GROUP BY 2"""
                   for m in NUMBERS])}),
t AS (SELECT measure, sum(n * a) / sum(n) AS grand FROM g GROUP BY 1),
s AS (SELECT measure, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * pow(a - grand, 2)) AS b, sum((n - 1) * v) AS w
  FROM g JOIN t USING (measure) GROUP BY 1),
f AS (SELECT *, (b / (k - 1)) / (w / (n - k)) AS f FROM s)
SELECT 'l_returnflag' AS category, measure, k AS groups, n, round(f, 4) AS statistic, k - 1 AS df_between, n - k AS df_within,
  round(pow(1 + 2 * f / (n - k), -(n - k) / 2.0), 6) AS p_value, pow(1 + 2 * f / (n - k), -(n - k) / 2.0) < 0.05 AS significant
FROM f""")
def anova_f(t: Tables) -> DataFrame:
    out = hypothesis.anova_f(t.lineitem, ["l_returnflag", "l_linestatus"], NUMBERS)
    return out.withColumns({"statistic": F.round("statistic", 4), "p_value": F.round("p_value", 6)})


# The 97.5 % point of t by its expansion around the normal point, exact to many digits for thousands of rows.
Z = 1.959963984540054
T_POINT = (f"({Z} + ({Z ** 3 + Z}) / (4 * (n - 1)) + ({5 * Z ** 5 + 16 * Z ** 3 + 3 * Z}) / (96 * pow(n - 1, 2)))")


@query("mean_ci", f"""
WITH m AS ({union([f"SELECT '{c}' AS c, count({c}) AS n, avg({c}) AS a, stddev_samp({c}) / sqrt(count({c})) AS s FROM lineitem"
                   for c in NUMBERS])})
SELECT c AS "column", n, round(a, 4) AS mean, CAST(0.95 AS DOUBLE) AS confidence_level, round(s * {T_POINT}, 4) AS margin_of_error,
  round(a - s * {T_POINT}, 4) AS ci_lower, round(a + s * {T_POINT}, 4) AS ci_upper FROM m""")
def mean_ci(t: Tables) -> DataFrame:
    return hypothesis.mean_ci(t.lineitem, NUMBERS)


@query("kpi_sales", """
SELECT round(sum(l_extendedprice), 2) AS total_revenue, round(avg(l_extendedprice), 2) AS average_order_value,
  round(max(l_extendedprice), 2) AS max_transaction, count(l_extendedprice) AS transactions,
  CAST(sum(l_quantity) AS BIGINT) AS units_sold FROM lineitem""")
def kpi_sales(t: Tables) -> DataFrame:
    named = t.lineitem.withColumnsRenamed({"l_extendedprice": "total_spend", "l_quantity": "quantity"})
    roles = kpi.resolve_roles(named.columns, ["quantity", "total_spend"])
    return kpi.kpi_sales(named, roles["revenue"], roles["units"])


KPI_CUSTOMERS = """
SELECT count(*) AS unique_customers, CAST(count_if(n > 1) AS BIGINT) AS repeat_customers,
  round(count_if(n > 1) * 100.0 / count(*), 2) AS repeat_rate, round(avg(n), 2) AS avg_orders_per_customer
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)"""


@query("kpi_customers", KPI_CUSTOMERS)
def kpi_customers(t: Tables) -> DataFrame:
    return kpi.kpi_customers(t.orders, "o_custkey")


KPI_RETURNS = """
SELECT CAST(count_if(l_returnflag = 'R') AS BIGINT) AS return_count, round(count_if(l_returnflag = 'R') * 100.0 / count(*), 2) AS return_rate,
  CAST(count_if(l_returnflag <> 'R') AS BIGINT) AS fulfilled FROM lineitem"""


@query("kpi_returns", KPI_RETURNS)
def kpi_returns(t: Tables) -> DataFrame:
    return kpi.kpi_returns(t.lineitem, "l_returnflag", ["r"])


def fit_sql(by: str = "") -> str:
    part, keep, group = (f"PARTITION BY {by} ", f"{by}, ", f"GROUP BY {by}") if by else ("", "", "")
    return f"""
x AS (SELECT *, row_number() OVER ({part}ORDER BY period) - 1 AS x FROM t),
fit AS (SELECT {keep}count(*) AS n, max(period) AS last_period, max(x) AS last_x, avg(y) AS mean, regr_slope(y, x) AS slope,
  regr_intercept(y, x) AS icept, regr_r2(y, x) AS r2, sqrt((1 - regr_r2(y, x)) * regr_syy(y, x) / regr_sxx(y, x) / (count(*) - 2)) AS se
  FROM x {group})"""


def ahead_sql(unit: str, by: str = "") -> str:
    keep = f"{by}, " if by else ""
    return f"""
SELECT {keep}step, CAST(CAST(last_period + to_{unit}s(step) AS DATE) AS VARCHAR) AS period, round(v, 2) AS forecast,
  round(greatest(0, v - 1.96 * se * sqrt(last_x + step)), 2) AS ci_lower, round(v + 1.96 * se * sqrt(last_x + step), 2) AS ci_upper
FROM (SELECT *, greatest(0, icept + slope * (last_x + step)) AS v
      FROM (SELECT *, CAST(unnest(range(1, 7)) AS INT) AS step FROM fit))"""


def dated(df: DataFrame) -> DataFrame:
    return df.withColumn("period", F.col("period").cast("string"))


@query("forecast_monthly", f"WITH {MONTHS}, {fit_sql()} {ahead_sql('month')}")
def forecast_monthly(t: Tables) -> DataFrame:
    return dated(forecast.forecast(t.orders, "o_orderdate", "o_totalprice"))


@query("forecast_daily", f"WITH {daily('events', 'ts', 'value')}, {fit_sql()} {ahead_sql('day')}")
def forecast_daily(t: Tables) -> DataFrame:
    return dated(forecast.forecast(t.events, "ts", "value"))


@query("forecast_by_segment", f"""
WITH {monthly('orders', 'o_orderdate', 'o_totalprice', 'o_orderpriority')}, {fit_sql('o_orderpriority')}
{ahead_sql('month', 'o_orderpriority')}""")
def forecast_by_segment(t: Tables) -> DataFrame:
    return dated(forecast.forecast(t.orders, "o_orderdate", "o_totalprice", by=["o_orderpriority"]))


@query("forecast_summary", f"""
WITH {MONTHS}, {fit_sql()}, p AS ({t_tail("fit", "(slope / se)", "(n - 2)", "n, slope, mean, r2")})
SELECT 'Monthly' AS granularity, n AS periods, CASE WHEN slope > 0 THEN 'Upward' ELSE 'Downward' END AS trend_direction,
  round(slope * 100 / mean, 2) AS slope_growth_pct, round(r2, 4) AS r_squared, p_value FROM p""")
def forecast_summary(t: Tables) -> DataFrame:
    out = forecast.forecast_summary(t.orders, "o_orderdate", "o_totalprice")
    return out.withColumn("p_value", F.round("p_value", 6))


@query("ml_split", """
SELECT o_orderstatus AS target_class, count(*) AS n_rows, count(*) - CAST(ceil(count(*) / 4.0) AS BIGINT) AS train_rows,
  CAST(ceil(count(*) / 4.0) AS BIGINT) AS test_rows FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1""")
def ml_split(t: Tables) -> DataFrame:
    return modeling.split_sizes(t.orders, "o_orderstatus")


@query("ml_classify")
def ml_classify(t: Tables) -> DataFrame:
    return modeling.train_baseline(t.orders, "o_orderstatus").metrics


@query("ml_regress")
def ml_regress(t: Tables) -> DataFrame:
    return modeling.train_baseline(t.part, "p_retailprice").metrics


@query("ml_importance")
def ml_importance(t: Tables) -> DataFrame:
    return modeling.train_baseline(t.customer, "c_acctbal").importance
