import pytest
from pyspark.sql import functions as F

from datalumen.functions.columns import formatted_number, parsed_date, strip
from datalumen.operators import cleaning, validation
from datalumen.operators.cleaning import CleaningOptions
from datalumen.operators.inspection import table_meta


@pytest.fixture(scope="module")
def result(sales):
    return cleaning.clean(sales, table_meta(sales))


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize("text, number", [
    ("$89,765", 89765.0), (" 23.5% ", 23.5), ("(123)", -123.0), ("-7", -7.0), ("1e3", 1000.0), ("TX1001", None), ("2025-01-02", None),
    ("01/02/2025", None), ("€ 1 234", 1234.0), ("", None), ("₹5", 5.0)])
def test_formatted_number(spark, text, number):
    assert one(spark, formatted_number, text) == number


def test_lenient_drops_everything_else(spark):
    assert one(spark, lambda c: formatted_number(c, lenient=True), "TX1001") == 1001.0


@pytest.mark.parametrize("text, day", [
    ("2025-01-03", "2025-01-03"), ("2025-01-03 04:05:06", "2025-01-03"), ("2025-01-03T04:05:06", "2025-01-03"),
    ("2025/01/03", "2025-01-03"), ("01/03/2025", "2025-01-03"), ("2025-13-40", None), ("1001", None), ("x", None)])
def test_parsed_date(spark, text, day):
    got = one(spark, parsed_date, text)
    assert (str(got.date()) if got else None) == day


def test_strip_takes_all_white_space(spark):
    assert one(spark, strip, "\t a b \n") == "a b"


def test_plan_cleans_everything(sales, result):
    out = result.cleaned
    assert out.count() == 30
    assert {r[0] for r in out.select("customer_gender").distinct().collect()} == {"Female", "Male"}
    assert dict(out.dtypes)["transaction_date"] == "timestamp"
    assert dict(out.dtypes)["price_text"] == "double"
    assert out.filter("customer_age IS NULL").count() == 0
    assert out.agg(F.max("total_spend")).first()[0] < 2500
    assert dict(out.dtypes)["transaction_id"] == "string"


def test_log_counts_what_changed(result):
    log = {r["issue"]: r["records_affected"] for r in result.log.collect()}
    assert log["duplicate rows"] == 1 and log["missing numbers"] == 1 and log["dates as text"] == 30
    assert log["formatted numbers"] == 31
    steps = [r["step"] for r in result.log.collect()]
    assert steps == list(range(1, len(steps) + 1))


def test_fitted_plan_applies_to_new_rows(sales, result):
    again = result.plan.apply(sales.filter("total_spend < 70"))
    assert again.columns == result.cleaned.columns and again.filter("customer_gender = 'F'").count() == 0


def test_switches(sales):
    off = CleaningOptions(numeric_strings=False, trim=False, nulls=False, dedup=False, labels=False, dates=False,
                          numeric_fill="none", category_fill="none", outliers="none")
    same = cleaning.clean(sales, table_meta(sales), off)
    assert same.log.count() == 0 and same.cleaned.exceptAll(sales).count() == 0


def test_durable_plan_gives_the_same_rows(sales, result):
    kept = cleaning.clean(sales, table_meta(sales), CleaningOptions(durable=True)).cleaned
    assert kept.exceptAll(result.cleaned).count() == 0


def test_report_leaves_values(sales):
    out = cleaning.clean(sales, table_meta(sales), CleaningOptions(outliers="report"))
    assert out.cleaned.agg(F.max("total_spend")).first()[0] == 2500
    assert "reported by iqr" in [r["action"] for r in out.log.collect()]


def test_flat_quartiles_fall_back_to_deviations(spark):
    df = spark.createDataFrame([(5.0,)] * 40 + [(900.0,)], "v double")
    assert cleaning.fit_fences(df, ["v"])["v"].method == "z-score"
    assert cleaning.fit_fences(df, ["v"])["v"].outliers == 1


def test_constant_and_short_columns_have_no_fence(spark):
    assert cleaning.fit_fences(spark.createDataFrame([(5.0,)] * 40, "v double"), ["v"]) == {}
    assert cleaning.fit_fences(spark.createDataFrame([(float(i),) for i in range(9)], "v double"), ["v"]) == {}


def test_empty_numbers_are_not_filled(spark):
    df = spark.createDataFrame([(None, "a"), (None, None)], "v double, c string")
    assert cleaning.fit_numeric_fill(df, ["v"]) == {}
    assert cleaning.fit_category_fill(df, ["c"]) == {"c": ("a", 1)}


def test_mode_takes_the_smallest_of_equals(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert cleaning.fit_category_fill(df, ["c"])["c"] == ("a", 1)


def test_summary(sales, result):
    row = validation.cleaning_summary(sales, result.cleaned, result.log).first()
    assert row["records_removed"] == 1 and row["duplicates_resolved"] == 1 and row["is_fully_clean"]


def test_large_mappings_are_joined(spark):
    mapping = {f"KEY{i}": f"label {i}" for i in range(20_000)} | {"F": "Female"}
    df = spark.createDataFrame([(1, " key7 "), (2, "f"), (3, "other"), (4, None), (5, "key19999")], "i int, c string")
    out = cleaning.clean_labels(df, {"c": mapping})
    assert out.columns == ["i", "c"]
    assert {r.i: r.c for r in out.collect()} == {1: "label 7", 2: "Female", 3: "other", 4: None, 5: "label 19999"}
    small = dict(list(mapping.items())[:50])
    same = cleaning.clean_labels(df, {"c": small}).exceptAll(cleaning._relabel_joined(df, "c", small))
    assert same.count() == 0


def test_values_lost_by_becoming_numbers_are_logged(spark):
    df = spark.createDataFrame([(f"k{i}", f"${i}.5" if i else "about ten") for i in range(40)], "name string, cost string")
    log = {(r["issue"], r["column"]): r["records_affected"] for r in cleaning.clean(df, table_meta(df)).log.collect()}
    assert log["formatted numbers", "cost"] == 39 and log["unreadable numbers", "cost"] == 1


def test_rows_are_counted_by_digests(spark):
    from datalumen.operators.inspection import duplicate_rows, row_counts
    df = spark.sql("""SELECT * FROM VALUES (1, NULL, 'a', 0.0D), (NULL, 1, 'a', -0.0D), (NULL, 1, 'a', 0.0D), (NULL, NULL, NULL, NULL),
                      (NULL, NULL, NULL, NULL), (1, 2, 'ab', double('NaN')), (1, 2, 'ab', double('NaN')) AS t(a, b, c, d)""")
    row = duplicate_rows(df).first()
    assert (row.num_rows, row.duplicate_rows) == (df.count(), df.count() - df.distinct().count()) == (7, 3)
    facts = row_counts(df, {"blank": F.col("a").isNull().cast("bigint")}).first()
    assert (facts.num_rows, facts.blank) == (7, 4)
    assert tuple(row_counts(df.limit(0), {"blank": F.lit(1)}).first()) == (0, 0, 0)
