"""Column roles, quality flags, profiles and the quality score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.functions import fixed
from datalumen.operators import inspection, profiling
from datalumen.plans.registry import DIRTY_CTE, Tables, query

DIRTY_COLUMNS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "priority": "string", "price": "double", "price_txt": "string",
    "gender": "string", "order_day": "string", "const_col": "string",
}


def words(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def bare(c: str) -> str:
    return f"regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"


def day_test(c: str) -> str:
    layouts = "['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y/%m/%d', '%m/%d/%Y']"
    return f"try_strptime({bare(c)}, {layouts}) IS NOT NULL"


def number_test(c: str) -> str:
    return f"regexp_matches(translate({bare(c)}, ',$%', ''), '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$')"


def rate(test: str, c: str) -> str:
    return f"coalesce(count_if({test}) * 1.0 / nullif(count({c}), 0), 0)"


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def column_facts(c: str, kind: str) -> str:
    text = kind == "string"
    return f"""
SELECT '{c}' AS "column", '{kind}' AS raw_type, count(*) AS total_count, count(*) - count({c}) AS missing_count,
  CAST({f"count_if(lower({bare(c)}) IN ({words(fixed.PLACEHOLDERS)}))" if text else "0"} AS BIGINT) AS null_like_count,
  count(DISTINCT {c}) AS unique_count,
  count_if(lower(CAST({c} AS VARCHAR)) IN ({words(fixed.BOOLEAN_WORDS)})) AS bools,
  {rate(day_test(c), c) if text else 0.0} AS days, {rate(number_test(c), c) if text else 1.0} AS numbers FROM d"""


INSPECT = f"""
WITH {DIRTY_CTE}, facts AS ({union([column_facts(c, k) for c, k in DIRTY_COLUMNS.items()])}),
typed AS (SELECT *, total_count - missing_count AS valid,
  CASE WHEN total_count = missing_count THEN 'empty'
       WHEN bools = total_count - missing_count AND unique_count <= 2 THEN 'boolean'
       WHEN days > 0.8 THEN 'datetime' WHEN numbers > 0.85 THEN 'numerical'
       WHEN unique_count * 1.0 / total_count < 0.3 OR unique_count <= 50 THEN 'categorical' ELSE 'text' END AS inferred_type
  FROM facts)
SELECT "column", raw_type, inferred_type,
  CASE WHEN regexp_matches("column", '(_id|id|code|key|num|no)$')
         OR (unique_count = total_count AND inferred_type <> 'numerical') THEN 'id' ELSE inferred_type END AS role,
  total_count, missing_count, null_like_count,
  round((missing_count + null_like_count) * 100.0 / total_count, 2) AS missing_pct, unique_count,
  round(unique_count * 100.0 / total_count, 2) AS unique_pct, unique_count <= 1 AS is_constant,
  unique_count > 1 AND unique_count * 100.0 / total_count > 80 AND inferred_type IN ('categorical', 'text') AS is_high_cardinality,
  unique_count = total_count AND missing_count = 0 AS is_key_candidate
FROM typed"""


@query("inspect_columns", INSPECT)
def inspect_columns(t: Tables) -> DataFrame:
    return inspection.inspect_columns(t.dirty).drop("position", "is_target_candidate", "pii_type")


@query("missing_by_column", f"""
WITH {DIRTY_CTE} SELECT "column", total_count, missing_count, null_like_count,
  round((missing_count + null_like_count) * 100.0 / total_count, 2) AS missing_pct
FROM ({union([column_facts(c, k) for c, k in DIRTY_COLUMNS.items()])})""")
def missing_by_column(t: Tables) -> DataFrame:
    return inspection.missing_by_column(t.dirty)


@query("distinct_by_column", union([
    f"""SELECT '{c}' AS "column", count(*) AS total_count, count(DISTINCT {c}) AS unique_count,
    round(count(DISTINCT {c}) * 100.0 / count(*), 2) AS unique_pct FROM lineitem"""
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")]))
def distinct_by_column(t: Tables) -> DataFrame:
    return inspection.distinct_by_column(t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"))


@query("pk_candidates", union([
    f"""SELECT '{c}' AS "column", count(*) AS total_count FROM customer HAVING count(DISTINCT {c}) = count(*)"""
    for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")]))
def pk_candidates(t: Tables) -> DataFrame:
    return inspection.pk_candidates(t.customer)


TEXTS = [c for c, k in DIRTY_COLUMNS.items() if k == "string"]


@query("datetime_parse_rate", f"""WITH {DIRTY_CTE} """ + union([
    f"""SELECT '{c}' AS "column", count({c}) AS valid_count, round({rate(day_test(c), c)}, 6) AS date_rate FROM d""" for c in TEXTS]))
def datetime_parse_rate(t: Tables) -> DataFrame:
    return inspection.datetime_parse_rate(t.dirty).withColumn("date_rate", F.round("date_rate", 6))


@query("numeric_string_rate", f"""WITH {DIRTY_CTE} """ + union([
    f"""SELECT '{c}' AS "column", count({c}) AS valid_count, round({rate(number_test(c), c)}, 6) AS number_rate FROM d""" for c in TEXTS]))
def numeric_string_rate(t: Tables) -> DataFrame:
    return inspection.numeric_string_rate(t.dirty).withColumn("number_rate", F.round("number_rate", 6))


def pii_sql(c: str) -> str:
    rates = ", ".join(
        f"round({rate(f'regexp_matches({c}, $p${p}$p$)', c)}, 6) AS {n}_rate" for n, p in fixed.PII_PATTERNS.items())
    return f"""SELECT '{c}' AS "column", count({c}) AS valid_count, {rates} FROM documents"""


@query("pii_rates", f"""
SELECT *, CASE WHEN email_rate > 0.4 THEN 'email' WHEN phone_rate > 0.4 THEN 'phone' WHEN ssn_rate > 0.4 THEN 'ssn'
  WHEN credit_card_rate > 0.4 THEN 'credit_card' END AS pii_type
FROM ({union([pii_sql(c) for c in ("text", "lang", "source")])})""")
def pii_rates(t: Tables) -> DataFrame:
    rates = inspection.pii_rates(t.documents)
    return rates.withColumns({f"{n}_rate": F.round(f"{n}_rate", 6) for n in fixed.PII_PATTERNS})


@query("duplicate_rows", f"""
WITH {DIRTY_CTE} SELECT count(*) AS num_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d))) * 100.0 / count(*), 2) AS duplicate_pct FROM d""")
def duplicate_rows(t: Tables) -> DataFrame:
    return inspection.duplicate_rows(t.dirty)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_numeric", union([f"""
SELECT '{c}' AS "column", 'ok' AS status, count(*) AS "count", count({c}) AS valid_count, count(*) - count({c}) AS missing_count,
  round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(skewness({c}), 4) AS skewness,
  round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS median,
  round(quantile_cont({c}, 0.75), 4) AS q75,
  round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr, count(DISTINCT {c}) AS unique_count
FROM lineitem""" for c in NUMBERS]))
def profile_numeric(t: Tables) -> DataFrame:
    return profiling.profile_numeric(t.lineitem, NUMBERS)


@query("profile_categorical", f"""
WITH {DIRTY_CTE}, v AS ({union([f"""SELECT '{c}' AS "column", coalesce({c}, 'nan') AS value FROM d"""
                                for c in ("priority", "gender", "const_col")])}),
c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY 1, 2),
s AS (SELECT "column", sum(n) AS total, count(*) AS levels FROM c GROUP BY 1),
r AS (SELECT c."column", count_if(n * 1.0 / total < 0.01) AS rare FROM c JOIN s USING ("column") GROUP BY 1)
SELECT "column", rank, value, n AS "count", round(n * 100.0 / total, 2) AS pct, CAST(total AS BIGINT) AS total_count,
  levels AS unique_count, CAST(rare AS BIGINT) AS rare_count
FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c) q
JOIN s USING ("column") JOIN r USING ("column") WHERE rank <= 5""")
def profile_categorical(t: Tables) -> DataFrame:
    return profiling.profile_categorical(t.dirty, ["priority", "gender", "const_col"])


@query("profile_datetime", """
SELECT 'o_orderdate' AS "column", count(*) AS total_count, count(o_orderdate) AS valid_count,
  count(*) - count(o_orderdate) AS missing_count, CAST(0 AS DOUBLE) AS missing_pct, CAST(min(o_orderdate) AS VARCHAR) AS min_date,
  CAST(max(o_orderdate) AS VARCHAR) AS max_date, datesub('day', min(o_orderdate), max(o_orderdate)) AS date_range_days
FROM orders""")
def profile_datetime(t: Tables) -> DataFrame:
    return profiling.profile_datetime(t.orders, ["o_orderdate"])


@query("describe_table", union([f"""
SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont({c}, 0.25), 4) AS p25,
  round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75 FROM part"""
    for c in ("p_size", "p_retailprice")]))
def describe_table(t: Tables) -> DataFrame:
    told = profiling.describe_table(t.part, ["p_size", "p_retailprice"])
    return told.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


QUALITY = f"""
WITH {DIRTY_CTE}, f AS (SELECT count(*) AS n, count(*) * 8 AS cells,
    count(*) * 8 - count(o_orderkey) - count(o_custkey) - count(priority) - count(price) - count(price_txt) - count(gender)
      - count(order_day) - count(const_col) AS gaps,
    count_if(lower({bare("priority")}) IN ({words(fixed.PLACEHOLDERS)})) AS holders,
    count_if(lower(gender) IN ({words(fixed.PLACEHOLDERS)})) AS more,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS dups FROM d),
p AS (SELECT round(least(30.0, gaps * 100.0 / cells * 1.5), 2) AS missing_penalty,
    round(least(20.0, round(dups * 100.0 / n, 2) * 2), 2) AS duplicate_penalty, 5.0 AS constant_penalty, 0.0 AS pii_penalty,
    round(least(10.0, (holders + more) * 100.0 / cells * 2), 2) AS placeholder_penalty FROM f)
SELECT CAST(missing_penalty AS DOUBLE) AS missing_penalty, CAST(duplicate_penalty AS DOUBLE) AS duplicate_penalty,
  CAST(constant_penalty AS DOUBLE) AS constant_penalty, CAST(pii_penalty AS DOUBLE) AS pii_penalty,
  CAST(placeholder_penalty AS DOUBLE) AS placeholder_penalty,
  CAST(round(100 - missing_penalty - duplicate_penalty - constant_penalty - pii_penalty - placeholder_penalty, 2) AS DOUBLE)
    AS quality_score FROM p"""


@query("quality_score", QUALITY)
def quality_score(t: Tables) -> DataFrame:
    return profiling.quality_score(t.dirty)
