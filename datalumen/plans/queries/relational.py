"""What the SQL console reaches in Spark: joins, set operations, grouping, windows, functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datalumen.operators.joins import asof_join, range_join
from datalumen.operators.ordered import framed, ranked
from datalumen.plans.console import query as console
from datalumen.plans.registry import Tables, query

SQL_CONSOLE = """
SELECT n.n_name, count(*) AS customers, round(sum(c.c_acctbal), 2) AS balance
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE c.c_acctbal > 0 GROUP BY n.n_name"""


@query("sql_console", SQL_CONSOLE)
def sql_console(t: Tables) -> DataFrame:
    return console(t.spark, SQL_CONSOLE, {"customer": t.customer, "nation": t.nation})


def spending(t: Tables) -> DataFrame:
    """Orders per customer; joins below meet one row per customer, whatever the busiest customer does."""
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("spent"))


SPENDING = "(SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY 1) s"


def by_segment(joined: DataFrame) -> DataFrame:
    return joined.groupBy("c_mktsegment").agg(
        F.count("*").alias("row_count"), F.count("n").alias("buyers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.round(F.coalesce(F.sum("spent"), F.lit(0.0)), 2).alias("spent"))


def join_sql(kind: str) -> str:
    return f"""SELECT c_mktsegment, count(*) AS row_count, count(n) AS buyers, CAST(coalesce(sum(n), 0) AS BIGINT) AS orders,
  round(coalesce(sum(spent), 0), 2) AS spent FROM customer {kind} JOIN {SPENDING} ON c_custkey = o_custkey GROUP BY 1"""


@query("join_inner", join_sql("INNER"))
def join_inner(t: Tables) -> DataFrame:
    return by_segment(t.customer.join(spending(t), F.col("c_custkey") == F.col("o_custkey")))


@query("join_left", join_sql("LEFT"))
def join_left(t: Tables) -> DataFrame:
    return by_segment(t.customer.join(spending(t), F.col("c_custkey") == F.col("o_custkey"), "left"))


@query("join_right", join_sql("RIGHT"))
def join_right(t: Tables) -> DataFrame:
    return by_segment(t.customer.join(spending(t), F.col("c_custkey") == F.col("o_custkey"), "right"))


@query("join_full", """
SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers
FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) c
FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c_nationkey = s_nationkey""")
def join_full(t: Tables) -> DataFrame:
    rich = t.customer.filter("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    held = t.supplier.filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    return rich.join(held, F.col("c_nationkey") == F.col("s_nationkey"), "full").select(
        F.coalesce("c_nationkey", "s_nationkey").alias("nation"), F.coalesce("c", F.lit(0)).alias("customers"),
        F.coalesce("s", F.lit(0)).alias("suppliers"))


@query("join_semi", """
SELECT c_mktsegment, count(*) AS customers FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1""")
def join_semi(t: Tables) -> DataFrame:
    # One row per buyer before the join, so the busiest customer weighs no more than any other.
    buyers = t.orders.select("o_custkey").distinct()
    return t.customer.join(buyers, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(
        F.count("*").alias("customers"))


@query("join_anti", """
SELECT p_brand, count(*) AS unsold FROM part
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09) GROUP BY 1""")
def join_anti(t: Tables) -> DataFrame:
    cheap = t.lineitem.filter("l_discount > 0.09").select("l_partkey").distinct()
    return t.part.join(cheap, F.col("p_partkey") == F.col("l_partkey"), "left_anti").groupBy("p_brand").agg(
        F.count("*").alias("unsold"))


@query("join_range", """
WITH b AS (SELECT s_nationkey, avg(s_acctbal) AS lo, avg(s_acctbal) + 250 AS hi FROM supplier GROUP BY 1)
SELECT s_nationkey, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
FROM customer JOIN b ON c_acctbal BETWEEN lo AND hi GROUP BY 1""")
def join_range(t: Tables) -> DataFrame:
    bands = t.supplier.groupBy("s_nationkey").agg(
        F.avg("s_acctbal").alias("lo"), (F.avg("s_acctbal") + 250).alias("hi"))
    met = range_join(t.customer.select("c_acctbal"), bands, "c_acctbal", "lo", "hi", 250.0)
    return met.groupBy("s_nationkey").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("join_asof", """
SELECT p.event_id, p.user_id, p.value, c.event_id AS click_id, c.value AS click_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def join_asof(t: Tables) -> DataFrame:
    bought = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    clicks = t.events.filter("event_type = 'click'").select(
        "user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return asof_join(bought, clicks, ["user_id"], "ts", "ts", ["click_id", "click_value"]).drop("ts")


def nation_keys(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))


@query("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(t: Tables) -> DataFrame:
    a, b = nation_keys(t)
    return a.unionAll(b)


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t: Tables) -> DataFrame:
    a, b = nation_keys(t)
    return a.union(b).distinct()


@query("set_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer")
def set_intersect(t: Tables) -> DataFrame:
    buyers = t.orders.select(F.col("o_custkey").alias("k")).distinct()
    return buyers.intersect(t.customer.select("c_custkey"))


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select("o_custkey").distinct())


@query("agg_having", """
SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1 HAVING count(*) > 12""")
def agg_having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent")).filter("orders > 12")


@query("agg_count_distinct", """
SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1""")
def agg_count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


GROUPED = "count(*) AS row_count, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY"


def grouped_totals(grouped) -> DataFrame:
    return grouped.agg(F.count("*").alias("row_count"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("agg_rollup", f"SELECT l_returnflag, l_linestatus, {GROUPED} ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(t: Tables) -> DataFrame:
    return grouped_totals(t.lineitem.rollup("l_returnflag", "l_linestatus"))


@query("agg_cube", f"SELECT l_returnflag, l_linestatus, {GROUPED} CUBE (l_returnflag, l_linestatus)")
def agg_cube(t: Tables) -> DataFrame:
    return grouped_totals(t.lineitem.cube("l_returnflag", "l_linestatus"))


GROUPING_SETS = f"SELECT l_returnflag, l_linestatus, {GROUPED} GROUPING SETS ((l_returnflag), (l_linestatus), ())"


@query("agg_grouping_sets", GROUPING_SETS)
def agg_grouping_sets(t: Tables) -> DataFrame:
    return console(t.spark, GROUPING_SETS, {"lineitem": t.lineitem})


@query("win_rank", """
SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, round(percent_rank() OVER w, 6) AS percent_rank,
  round(cume_dist() OVER w, 6) AS cume_dist FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC)""")
def win_rank(t: Tables) -> DataFrame:
    rows = ranked(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", True)
    return rows.select("o_orderkey", "rank", "dense_rank", F.round("percent_rank", 6).alias("percent_rank"),
                       F.round("cume_dist", 6).alias("cume_dist"))


@query("win_lag_lead", """
SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS following,
  round(o_totalprice - lag(o_totalprice) OVER w, 2) AS change FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def win_lag_lead(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = framed(rows, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], {
        "previous": lambda w: F.lag("o_orderkey").over(w), "following": lambda w: F.lead("o_orderkey").over(w),
        "change": lambda w: F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2)}, before=1, after=1)
    return out.select("o_orderkey", "previous", "following", "change")


@query("win_first_last", """
SELECT o_orderkey, first_value(o_totalprice) OVER w AS first_price, last_value(o_totalprice) OVER w AS last_price FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def win_first_last(t: Tables) -> DataFrame:
    order = F.struct("o_orderdate", "o_orderkey")
    ends = t.orders.groupBy("o_custkey").agg(
        F.min_by("o_totalprice", order).alias("first_price"), F.max_by("o_totalprice", order).alias("last_price"))
    return t.orders.select("o_orderkey", "o_custkey").join(ends, "o_custkey").select("o_orderkey", "first_price", "last_price")


@query("win_frames", """
WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS spent FROM orders GROUP BY 1, 2)
SELECT o_custkey, CAST(day AS VARCHAR) AS day,
  round(avg(spent) OVER (PARTITION BY o_custkey ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS avg_3,
  round(sum(spent) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW), 2) AS sum_90_days
FROM d""")
def win_frames(t: Tables) -> DataFrame:
    # Day totals first: a window then holds at most one row per calendar day, however busy the customer.
    days = t.orders.groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("spent"))
    rows = Window.partitionBy("o_custkey").orderBy("day").rowsBetween(-2, 0)
    number = F.datediff("day", F.lit("1970-01-01"))
    span = Window.partitionBy("o_custkey").orderBy(number).rangeBetween(-90, 0)
    return days.select("o_custkey", F.col("day").cast("string").alias("day"), F.round(F.avg("spent").over(rows), 4).alias("avg_3"),
                       F.round(F.sum("spent").over(span), 2).alias("sum_90_days"))


CTE_SUBQUERY = """
WITH RECURSIVE years(y) AS (SELECT (SELECT min(year(o_orderdate)) FROM orders)
  UNION ALL SELECT y + 1 FROM years WHERE y < (SELECT max(year(o_orderdate)) FROM orders)),
totals AS (SELECT year(o_orderdate) AS y, o_orderpriority, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT CAST(years.y AS BIGINT) AS y, o_orderpriority, round(total, 2) AS total,
  total > (SELECT avg(i.total) FROM totals i WHERE i.y = t.y) AS above_average
FROM years JOIN totals t ON t.y = years.y"""


@query("cte_subquery", CTE_SUBQUERY)
def cte_subquery(t: Tables) -> DataFrame:
    edges = t.orders.agg(F.min(F.year("o_orderdate")).alias("lo"), F.max(F.year("o_orderdate")).alias("hi")).first()
    # A recursive step takes constants only, so the two ends of the calendar are looked up first.
    text = CTE_SUBQUERY.replace("(SELECT min(year(o_orderdate)) FROM orders)", str(edges["lo"])).replace(
        "(SELECT max(year(o_orderdate)) FROM orders)", str(edges["hi"]))
    return console(t.spark, text, {"orders": t.orders})


PRED_MIX = """
SELECT CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice BETWEEN 100000 AND 300000 THEN 'mid' ELSE 'high' END AS band,
  coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status, count(*) AS orders FROM orders
WHERE o_orderpriority LIKE '%URGENT%' OR o_orderpriority IN ('2-HIGH', '5-LOW') AND o_orderdate IS NOT NULL GROUP BY 1, 2"""


@query("pred_mix", PRED_MIX)
def pred_mix(t: Tables) -> DataFrame:
    return console(t.spark, PRED_MIX, {"orders": t.orders})


@query("fn_string", """
SELECT c_custkey, trim(concat(' ', c_name, ' ')) AS trimmed, lower(c_mktsegment) AS low, upper(c_name) AS up,
  regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, split_part(c_name, '#', 2) AS number, substr(c_name, 1, 8) AS head,
  CAST(instr(c_name, '#') AS INT) AS place, CAST(length(c_name) AS INT) AS size, replace(c_name, '#', '-') AS dashed,
  regexp_matches(c_mktsegment, '^B') AS starts_b, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) AS title FROM customer""")
def fn_string(t: Tables) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey", F.trim(F.concat(F.lit(" "), name, F.lit(" "))).alias("trimmed"), F.lower(segment).alias("low"),
        F.upper(name).alias("up"), F.regexp_replace(name, "[^0-9]", "").alias("digits"),
        F.split_part(name, F.lit("#"), F.lit(2)).alias("number"), F.substring(name, 1, 8).alias("head"),
        F.instr(name, "#").alias("place"), F.length(name).alias("size"),
        F.replace(name, F.lit("#"), F.lit("-")).alias("dashed"), segment.rlike("^B").alias("starts_b"),
        F.initcap(segment).alias("title"))


@query("fn_date", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month_start,
  CAST(last_day(o_orderdate) AS VARCHAR) AS month_end, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS next_month,
  CAST(CAST(o_orderdate AS DATE) + 7 AS VARCHAR) AS next_week, CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS since,
  CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(quarter(o_orderdate) AS INT) AS q,
  strftime(o_orderdate, '%Y%m') AS stamp FROM orders""")
def fn_date(t: Tables) -> DataFrame:
    at, day = F.col("o_orderdate"), F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey", day.cast("string").alias("day"), F.date_trunc("month", at).cast("date").cast("string").alias("month_start"),
        F.last_day(day).cast("string").alias("month_end"), F.add_months(day, 1).cast("string").alias("next_month"),
        F.date_add(day, 7).cast("string").alias("next_week"), F.datediff(day, F.lit("1992-01-01")).alias("since"),
        F.year(at).alias("y"), F.month(at).alias("m"), F.quarter(at).alias("q"), F.date_format(at, "yyyyMM").alias("stamp"))


@query("fn_math", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 8) AS unit, abs(l_discount - l_tax) AS gap,
  round(sqrt(l_extendedprice), 6) AS root, least(greatest(l_quantity, 10), 40) AS clamped, round(ln(l_extendedprice), 6) AS log_price,
  floor(l_extendedprice / 1000) * 1.0 AS thousands, round(pow(l_quantity, 2), 2) AS square FROM lineitem""")
def fn_math(t: Tables) -> DataFrame:
    price, n = F.col("l_extendedprice"), F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round(price / n, 8).alias("unit"), F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"),
        F.round(F.sqrt(price), 6).alias("root"), F.least(F.greatest(n, F.lit(10.0)), F.lit(40.0)).alias("clamped"),
        F.round(F.ln(price), 6).alias("log_price"), F.floor(price / 1000).cast("double").alias("thousands"),
        F.round(F.pow(n, F.lit(2.0)), 2).alias("square"))


@query("fn_json", """
SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
  max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY 1""")
def fn_json(t: Tables) -> DataFrame:
    parsed = t.events.select("event_type", F.from_json("props", "k BIGINT").getField("k").alias("k"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("k").alias("total"), F.max("k").alias("most"))


@query("fn_array", """
SELECT vec_id, len(embedding) AS size, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm2,
  len(list_filter(embedding, lambda x: x > 0)) AS positive, round(CAST(list_max(embedding) AS DOUBLE), 6) AS most FROM embeddings""")
def fn_array(t: Tables) -> DataFrame:
    v = F.col("embedding")
    squares = F.aggregate(F.transform(v, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    return t.embeddings.select(
        "vec_id", F.size(v).cast("bigint").alias("size"), F.round(squares, 4).alias("norm2"),
        F.size(F.filter(v, lambda x: x > 0)).cast("bigint").alias("positive"),
        F.round(F.array_max(v).cast("double"), 6).alias("most"))


@query("fn_map", """
SELECT c_custkey, c_mktsegment AS segment, c_nationkey AS nation, 2 AS entries,
  CASE WHEN c_nationkey > 12 THEN 'upper' ELSE 'lower' END AS half FROM customer""")
def fn_map(t: Tables) -> DataFrame:
    facts = F.map_from_arrays(F.array(F.lit("segment"), F.lit("nation")), F.array("c_mktsegment", F.col("c_nationkey").cast("string")))
    half = F.create_map(F.lit(True), F.lit("upper"), F.lit(False), F.lit("lower"))
    return t.customer.select(
        "c_custkey", facts["segment"].alias("segment"), facts["nation"].cast("int").alias("nation"), F.size(facts).alias("entries"),
        half[F.col("c_nationkey") > 12].alias("half"))
