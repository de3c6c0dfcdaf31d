import pytest
from pyspark.sql import functions as F

from datalumen.operators.catalog import classify_tables, table_catalog
from datalumen.plans.analysis import AnalysisOptions, analyze
from datalumen.streaming import streams


@pytest.fixture(scope="module")
def result(spark, sales):
    return analyze(spark, sales)


def test_all_tables_can_be_read(result):
    assert {"columns", "quality", "log", "validation", "numeric", "categorical", "dates", "pearson", "spearman", "segments",
            "welch", "anova", "chi_square", "trend", "growth", "forecast", "kpi_sales", "kpi_customers", "kpi_returns",
            "alerts", "model_metrics", "model_importance", "charts"} <= set(result.tables)
    counts = {name: df.count() for name, df in result.tables.items()}
    assert counts["columns"] == 10 and counts["forecast"] == 6 and counts["trend"] == 13
    assert counts["alerts"] > 0


def test_figures_are_taken_before_clipping(spark, sales, result):
    clipped = analyze(spark, sales, AnalysisOptions(kpi_on_clipped=True))
    full = result.tables["kpi_sales"].first()["max_transaction"]
    assert full == 2500.0 > clipped.tables["kpi_sales"].first()["max_transaction"]


def test_classified_by_column_names(spark):
    tables = {
        "shop": spark.range(2).selectExpr("id AS order_id", "id AS product", "id AS cart", "id AS checkout_sku", "id AS coupon"),
        "plain": spark.range(3).selectExpr("id AS x", "id AS y")}
    rows = {r["table"]: r for r in classify_tables(table_catalog(tables)).collect()}
    # order, product, cart, checkout, sku and coupon
    assert (rows["shop"]["domain"], rows["shop"]["confidence"], rows["shop"]["score"]) == ("E-Commerce & Retail", "High", 17)
    assert (rows["plain"]["domain"], rows["plain"]["confidence"], rows["plain"]["num_rows"]) == ("General / Mixed", "Unknown", 3)


def test_fitted_plan_on_a_stream(spark, sales, result, tmp_path):
    sales.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sales.schema).parquet(str(tmp_path / "in"))
    out = streams.run_to_files(streams.clean_stream(stream, result.plan), "clean")
    assert out.count() == 31 and out.filter("customer_gender NOT IN ('Female', 'Male')").count() == 0


def test_odd_names_and_nested_columns(spark, tables):
    o = tables["orders"].limit(300)
    df = o.select(
        F.col("o_orderstatus").alias("order.status"), F.col("o_totalprice").alias("total price"), F.col("o_orderdate").alias("when.at"),
        F.col("o_orderpriority").alias("prio`x"), (F.col("o_custkey") % 7).alias("n.items"), F.struct("o_custkey").alias("nest"),
        F.array("o_custkey").alias("list"))
    result = analyze(spark, df, AnalysisOptions(target="order.status"))
    assert all(table.columns and table.count() >= 0 for table in result.tables.values())
    assert result.tables["model_metrics"].count() == 6
