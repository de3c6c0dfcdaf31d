"""Cleaning steps, the full cleaning plan, and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.operators import cleaning, validation
from datalumen.operators.inspection import table_meta
from datalumen.plans.queries.inspection import bare
from datalumen.plans.registry import DIRTY_CTE, Tables, query

NUMBER = "CAST(replace(price_txt, '$', '') AS DOUBLE)"
LABEL = "CASE upper(gender) WHEN 'F' THEN 'Female' WHEN 'FEMALE' THEN 'Female' WHEN 'M' THEN 'Male' WHEN 'MALE' THEN 'Male' ELSE gender END"
NULLED = f"CASE WHEN lower({bare('priority')}) IN ('', 'n/a', 'na', 'null', 'none', 'nan', 'missing', 'unknown', '?', '-', '.') THEN NULL ELSE {bare('priority')} END"


@query("clean_numeric_strings", f"WITH {DIRTY_CTE} SELECT o_orderkey, priority, {NUMBER} AS price_txt, order_day FROM d")
def clean_numeric_strings(t: Tables) -> DataFrame:
    return cleaning.clean_numeric_strings(t.dirty).select("o_orderkey", "priority", "price_txt", "order_day")


@query("clean_trim", f"WITH {DIRTY_CTE} SELECT o_orderkey, {bare('priority')} AS priority FROM d")
def clean_trim(t: Tables) -> DataFrame:
    return cleaning.clean_trim(t.dirty).select("o_orderkey", "priority")


@query("clean_nulls", f"WITH {DIRTY_CTE} SELECT o_orderkey, CASE WHEN priority <> 'N/A' THEN priority END AS priority FROM d")
def clean_nulls(t: Tables) -> DataFrame:
    return cleaning.clean_nulls(t.dirty).select("o_orderkey", "priority")


@query("clean_dedup", f"WITH {DIRTY_CTE} SELECT DISTINCT * FROM d")
def clean_dedup(t: Tables) -> DataFrame:
    return cleaning.clean_dedup(t.dirty)


@query("clean_labels", f"WITH {DIRTY_CTE} SELECT o_orderkey, {LABEL} AS gender FROM d")
def clean_labels(t: Tables) -> DataFrame:
    return cleaning.clean_labels(t.dirty).select("o_orderkey", "gender")


@query("clean_cast_dates", f"""
WITH {DIRTY_CTE} SELECT o_orderkey, year(CAST(order_day AS DATE)) * 10000 + month(CAST(order_day AS DATE)) * 100
  + day(CAST(order_day AS DATE)) AS day_number FROM d""")
def clean_cast_dates(t: Tables) -> DataFrame:
    days = cleaning.clean_cast_dates(t.dirty, ["order_day"])
    day = F.col("order_day")
    return days.select("o_orderkey", (F.year(day) * 10000 + F.month(day) * 100 + F.day(day)).cast("bigint").alias("day_number"))


def filled(statistic: str) -> str:
    return f"WITH {DIRTY_CTE} SELECT o_orderkey, round(coalesce(price, (SELECT {statistic} FROM d)), 4) AS price FROM d"


def impute(t: Tables, strategy: str) -> DataFrame:
    return cleaning.impute_numeric(t.dirty, ["price"], strategy).select("o_orderkey", F.round("price", 4).alias("price"))


@query("impute_median", filled("median(price)"))
def impute_median(t: Tables) -> DataFrame:
    return impute(t, "median")


@query("impute_mean", filled("avg(price)"))
def impute_mean(t: Tables) -> DataFrame:
    return impute(t, "mean")


@query("impute_auto", filled("CASE WHEN abs(skewness(price)) > 0.5 THEN median(price) ELSE avg(price) END"))
def impute_auto(t: Tables) -> DataFrame:
    return impute(t, "auto")


@query("impute_mode", f"""
WITH {DIRTY_CTE}, c AS (SELECT o_orderkey, {NULLED} AS priority FROM d),
m AS (SELECT priority FROM c WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1)
SELECT o_orderkey, coalesce(priority, (SELECT priority FROM m)) AS priority FROM c""")
def impute_mode(t: Tables) -> DataFrame:
    ready = cleaning.clean_nulls(cleaning.clean_trim(t.dirty))
    return cleaning.impute_category(ready, ["priority"]).select("o_orderkey", "priority")


@query("impute_unknown", f"WITH {DIRTY_CTE} SELECT o_orderkey, coalesce(priority, 'Unknown') AS priority FROM d")
def impute_unknown(t: Tables) -> DataFrame:
    return cleaning.impute_category(t.dirty, ["priority"], "unknown").select("o_orderkey", "priority")


FENCES = """q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM d),
f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


@query("outlier_clip", f"""
WITH {DIRTY_CTE}, {FENCES} SELECT o_orderkey, CASE WHEN price IS NOT NULL THEN
  round(least(greatest(price, (SELECT lo FROM f)), (SELECT hi FROM f)), 6) END AS price FROM d""")
def outlier_clip(t: Tables) -> DataFrame:
    return cleaning.outlier_clip(t.dirty, ["price"]).select("o_orderkey", F.round("price", 6).alias("price"))


@query("outlier_report", f"""
WITH {DIRTY_CTE}, {FENCES} SELECT 'price' AS "column", 'iqr' AS method, count(price) AS valid_count,
  CAST(count_if(price < (SELECT lo FROM f) OR price > (SELECT hi FROM f)) AS BIGINT) AS outlier_count,
  round(count_if(price < (SELECT lo FROM f) OR price > (SELECT hi FROM f)) * 100.0 / count(price), 1) AS outlier_pct,
  round((SELECT lo FROM f), 2) AS lower_fence, round((SELECT hi FROM f), 2) AS upper_fence FROM d""")
def outlier_report(t: Tables) -> DataFrame:
    return cleaning.outlier_report(t.dirty, ["price"])


# The whole plan in SQL: cells, duplicates, labels and dates, fills, fences.
STEPS = f"""{DIRTY_CTE},
cells AS (SELECT o_orderkey, o_custkey, {NULLED} AS priority, price, {NUMBER} AS price_txt, gender, order_day, const_col FROM d),
uniq AS (SELECT DISTINCT * FROM cells),
named AS (SELECT * REPLACE ({LABEL} AS gender) FROM uniq),
best AS (SELECT priority FROM named WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1),
full_rows AS (SELECT * REPLACE (coalesce(price, (SELECT median(price) FROM named)) AS price,
  coalesce(priority, (SELECT priority FROM best)) AS priority) FROM named),
quart AS (SELECT quantile_cont(price, 0.25) AS a1, quantile_cont(price, 0.75) AS a3,
  quantile_cont(price_txt, 0.25) AS b1, quantile_cont(price_txt, 0.75) AS b3 FROM full_rows),
fence AS (SELECT a1 - 1.5 * (a3 - a1) AS alo, a3 + 1.5 * (a3 - a1) AS ahi,
  b1 - 1.5 * (b3 - b1) AS blo, b3 + 1.5 * (b3 - b1) AS bhi FROM quart),
done AS (SELECT o_orderkey, o_custkey, priority, least(greatest(price, alo), ahi) AS price,
  least(greatest(price_txt, blo), bhi) AS price_txt, gender, CAST(order_day AS DATE) AS order_day, const_col
  FROM full_rows, fence)"""


def cleaned(t: Tables) -> cleaning.CleaningResult:
    return cleaning.clean(t.dirty, table_meta(t.dirty))


@query("clean_full", f"""
WITH {STEPS} SELECT o_orderkey, o_custkey, priority, round(price, 6) AS price, round(price_txt, 6) AS price_txt, gender,
  CAST(order_day AS VARCHAR) AS order_day, const_col FROM done""")
def clean_full(t: Tables) -> DataFrame:
    out = cleaned(t).cleaned
    return out.withColumns({
        "price": F.round("price", 6), "price_txt": F.round("price_txt", 6),
        "order_day": F.col("order_day").cast("date").cast("string")})


LOG = f"""
SELECT CAST(row_number() OVER (ORDER BY k) AS INT) AS step, issue, "column", CAST(records_affected AS BIGINT) AS records_affected FROM (
  SELECT 1 AS k, 'formatted numbers' AS issue, 'price_txt' AS "column", (SELECT count(price_txt) FROM cells) AS records_affected
  UNION ALL SELECT 2, 'white space', 'priority', (SELECT count_if(priority <> {bare("priority")}) FROM d)
  UNION ALL SELECT 3, 'placeholders', 'priority', (SELECT count(*) FROM d WHERE priority = 'N/A')
  UNION ALL SELECT 4, 'duplicate rows', '*', (SELECT count(*) FROM cells) - (SELECT count(*) FROM uniq)
  UNION ALL SELECT 5, 'label spellings', 'gender', (SELECT count_if(gender <> {LABEL}) FROM uniq)
  UNION ALL SELECT 6, 'dates as text', 'order_day', (SELECT count(order_day) FROM uniq)
  UNION ALL SELECT 7, 'missing numbers', 'price', (SELECT count(*) - count(price) FROM named)
  UNION ALL SELECT 8, 'missing labels', 'priority', (SELECT count(*) - count(priority) FROM named)
  UNION ALL SELECT 9, 'outliers', 'price', (SELECT count_if(price < alo OR price > ahi) FROM full_rows, fence)
  UNION ALL SELECT 10, 'outliers', 'price_txt', (SELECT count_if(price_txt < blo OR price_txt > bhi) FROM full_rows, fence))
WHERE records_affected > 0"""


@query("cleaning_log", f"WITH {STEPS} {LOG}")
def cleaning_log(t: Tables) -> DataFrame:
    return cleaned(t).log.select("step", "issue", "column", "records_affected")


def gaps(table: str) -> str:
    names = ("o_orderkey", "o_custkey", "priority", "price", "price_txt", "gender", "order_day", "const_col")
    return f"(SELECT count(*) * 8 - {' - '.join(f'count({c})' for c in names)} FROM {table})"


def copies(table: str) -> str:
    return f"((SELECT count(*) FROM {table}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})))"


COMPARED = f"""SELECT *, after_cleaning - before_cleaning AS delta FROM (
  SELECT 'rows' AS metric, (SELECT count(*) FROM d) AS before_cleaning, (SELECT count(*) FROM done) AS after_cleaning
  UNION ALL SELECT 'columns', 8, 8
  UNION ALL SELECT 'missing', {gaps("d")}, {gaps("done")}
  UNION ALL SELECT 'duplicates', {copies("d")}, {copies("done")})"""


@query("validate_before_after", f"WITH {STEPS} {COMPARED}")
def validate_before_after(t: Tables) -> DataFrame:
    return validation.before_after(t.dirty, cleaned(t).cleaned)


@query("validate_summary", f"""
WITH {STEPS}, moves AS ({LOG}) SELECT (SELECT count(*) FROM d) - (SELECT count(*) FROM done) AS records_removed,
  {gaps("d")} - {gaps("done")} AS missing_resolved, {copies("d")} - {copies("done")} AS duplicates_resolved,
  {gaps("done")} AS remaining_missing, {copies("done")} AS remaining_duplicates,
  (SELECT CAST(sum(records_affected) AS BIGINT) FROM moves WHERE issue <> 'duplicate rows') AS records_modified,
  {gaps("done")} = 0 AND {copies("done")} = 0 AS is_fully_clean""")
def validate_summary(t: Tables) -> DataFrame:
    result = cleaned(t)
    return validation.cleaning_summary(t.dirty, result.cleaned, result.log)
