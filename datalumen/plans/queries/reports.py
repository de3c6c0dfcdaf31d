"""The stock console queries, catalogue classification and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.functions import fixed
from datalumen.operators import exploration, hypothesis, kpi, profiling
from datalumen.operators.alerts import alerts
from datalumen.operators.catalog import classify_tables, table_catalog
from datalumen.plans import templates
from datalumen.plans.queries.exploration import ANOMALIES, GROWTH, SEGMENT_ENDS, SEGMENTS, PAIRS
from datalumen.plans.queries.inspection import QUALITY, union
from datalumen.plans.queries.statistics import CHI_YATES, KPI_CUSTOMERS, KPI_RETURNS
from datalumen.plans.registry import NAMES, Tables, query


@query("top_segment_summary", """
SELECT p_brand, count(*) AS total_records, round(sum(p_retailprice), 2) AS total, round(avg(p_retailprice), 2) AS average
FROM part GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""")
def top_segment_summary(t: Tables) -> DataFrame:
    return templates.top_segment_summary(t.part, "p_brand", "p_retailprice")


@query("top_n_segments", """
SELECT o_orderpriority, count(*) AS total_records, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS average
FROM orders GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 3""")
def top_n_segments(t: Tables) -> DataFrame:
    return templates.top_segment_summary(t.orders, "o_orderpriority", "o_totalprice", 3)


@query("segment_rank", f"SELECT *, row_number() OVER (ORDER BY \"sum\" DESC) AS place FROM ({SEGMENTS.split(' UNION ALL ')[1]})")
def segment_rank(t: Tables) -> DataFrame:
    segments = exploration.segment_breakdown(t.lineitem, ["l_returnflag"], ["l_extendedprice"])
    return templates.numbered(segments, [], [F.desc("sum"), F.asc("segment")], "place")


@query("count_breakdown", "SELECT p_type, count(*) AS total_records FROM part GROUP BY 1")
def count_breakdown(t: Tables) -> DataFrame:
    return templates.count_breakdown(t.part, "p_type")


@query("avg_by_segment", "SELECT c_mktsegment, round(avg(c_acctbal), 2) AS average FROM customer GROUP BY 1")
def avg_by_segment(t: Tables) -> DataFrame:
    return templates.avg_by_segment(t.customer, "c_mktsegment", "c_acctbal")


MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("metric_summary", "SELECT " + ", ".join(
    f"round({f}({m}), 2) AS {f}_{m}" for m in MEASURES for f in ("avg", "min", "max")) + " FROM lineitem")
def metric_summary(t: Tables) -> DataFrame:
    return templates.metric_summary(t.lineitem, MEASURES)


@query("running_total_trend", """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS daily FROM orders GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, daily, round(sum(daily) OVER (ORDER BY day), 2) AS cumulative,
  round(avg(daily) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2) AS moving_avg_7 FROM d""")
def running_total_trend(t: Tables) -> DataFrame:
    trend = templates.running_total_trend(t.orders, "o_orderdate", "o_totalprice")
    return trend.withColumn("day", F.col("day").cast("string"))


@query("quartile_ntile", """
SELECT o_orderkey, ntile(4) OVER (ORDER BY o_totalprice DESC, o_orderkey) AS quartile FROM orders""")
def quartile_ntile(t: Tables) -> DataFrame:
    return templates.quartile_ntile(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"]).drop("o_totalprice")


@query("quartile_cutpoints", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b,
  quantile_cont(o_totalprice, 0.75) AS c FROM orders)
SELECT o_orderkey, CAST(CASE WHEN o_totalprice > c THEN 1 WHEN o_totalprice > b THEN 2 WHEN o_totalprice > a THEN 3 ELSE 4 END AS BIGINT)
  AS quartile FROM orders, q""")
def quartile_cutpoints(t: Tables) -> DataFrame:
    return templates.quartile_cutpoints(t.orders, "o_totalprice").select("o_orderkey", "quartile")


@query("running_total_by_customer", """
SELECT o_orderkey, row_number() OVER w AS position, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def running_total_by_customer(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = templates.running_total(rows, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], "o_totalprice")
    return out.select("o_orderkey", "position", F.round("running", 2).alias("running"))


KEYWORDS = ", ".join(
    f"({place}, '{domain}', '{word}', {weight})"
    for place, (domain, words) in enumerate(fixed.DOMAIN_KEYWORDS.items()) for word, weight in words.items())


@query("classify_tables", f"""
WITH k(place, domain, word, weight) AS (VALUES {KEYWORDS}),
n AS ({union([f"SELECT '{n}' AS t, count(*) AS num_rows FROM {n}" for n in NAMES])}),
c AS (SELECT DISTINCT table_name AS t, lower(column_name) AS c FROM information_schema.columns),
h AS (SELECT n.t, k.place, k.domain, sum(CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.t = n.t AND contains(c.c, k.word))
  THEN k.weight ELSE 0 END) AS score FROM n CROSS JOIN k GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, place) AS rn FROM h)
SELECT n.t AS "table", num_rows, CASE WHEN a.score >= 3 THEN a.domain ELSE 'General / Mixed' END AS domain,
  CASE WHEN a.score >= 15 THEN 'High' WHEN a.score >= 7 THEN 'Medium' WHEN a.score >= 3 THEN 'Low' ELSE 'Unknown' END AS confidence,
  CAST(a.score AS BIGINT) AS score, b.domain AS runner_up
FROM n JOIN r a ON a.t = n.t AND a.rn = 1 JOIN r b ON b.t = n.t AND b.rn = 2""")
def classified(t: Tables) -> DataFrame:
    return classify_tables(table_catalog({n: t[n] for n in NAMES}))


@query("alerts", f"""
SELECT 'descriptive' AS level, 'quality_score' AS metric, 'table' AS subject, round(quality_score, 4) AS value,
  CAST(95 AS DOUBLE) AS threshold FROM ({QUALITY}) WHERE quality_score < 95
UNION ALL SELECT 'diagnostic', 'segment_gap', measure || ' by ' || category || ': ' || top_segment || ' over ' || bottom_segment,
  round(top_sum - bottom_sum, 4), 0 FROM ({SEGMENT_ENDS}) WHERE top_sum > bottom_sum
UNION ALL SELECT 'diagnostic', 'significant_test', var1 || ' by ' || var2, statistic, 0.05 FROM ({CHI_YATES}) WHERE statistic > 3.841458820694124
UNION ALL SELECT 'predictive', 'growth_pct', measure, percentage_growth, 0 FROM ({GROWTH}) WHERE percentage_growth <> 0
UNION ALL SELECT 'prescriptive', 'outliers', "column", iqr_outlier_count, 0 FROM ({ANOMALIES}) WHERE iqr_outlier_count > 0
UNION ALL SELECT 'descriptive', 'return_rate', 'table', return_rate, 0 FROM ({KPI_RETURNS}) WHERE return_rate > 0
UNION ALL SELECT 'descriptive', 'repeat_rate', 'table', repeat_rate, 0 FROM ({KPI_CUSTOMERS})""")
def alert_list(t: Tables) -> DataFrame:
    return alerts(
        quality=profiling.quality_score(t.dirty), segments=exploration.segment_top_bottom(t.lineitem, *PAIRS),
        tests=[hypothesis.chi_square(t.labels, ["quality", "toxic"])],
        growth=exploration.trend_growth(t.orders, "o_orderdate", ["o_totalprice"]),
        anomalies=exploration.anomaly_iqr(t.dirty, ["price"]), returns=kpi.kpi_returns(t.lineitem, "l_returnflag", ["r"]),
        customers=kpi.kpi_customers(t.orders, "o_custkey"))
