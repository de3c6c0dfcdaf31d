import pytest
from pyspark.sql import functions as F

from datalumen.operators import charts, cleaning, exploration, forecast, hypothesis, inspection, kpi, modeling, profiling


def test_roles(sales):
    meta = inspection.table_meta(sales)
    assert set(meta.id_columns) == {"transaction_id", "customer_id"}
    assert meta.datetime_columns == ("transaction_date",)
    assert meta.boolean_columns == ("is_returned",) and meta.target_candidates == ("is_returned",)
    assert meta.numerical_columns == ("customer_age", "units_sold", "total_spend", "price_text")
    assert set(meta.categorical_columns) == {"customer_gender", "product_category"}


def test_empty_constant_and_nan(spark):
    df = spark.createDataFrame([(None, 1, float("nan"), "x"), (None, 1, 2.0, "?")], "e string, k int, f double, t string")
    rows = {r["column"]: r for r in inspection.inspect_columns(df).collect()}
    assert rows["e"]["inferred_type"] == "empty" and rows["e"]["role"] == "text"
    assert rows["k"]["is_constant"] and rows["f"]["missing_count"] == 1
    assert rows["t"]["null_like_count"] == 1 and rows["t"]["missing_pct"] == 50.0


def test_personal_data(spark):
    df = spark.createDataFrame([("a@b.co", "123-45-6789", "555-123-4567"), ("c@d.org", "987-65-4321", "555.987.6543")],
                               "m string, s string, p string")
    found = {r["column"]: r["pii_type"] for r in inspection.inspect_columns(df).collect()}
    assert found == {"m": "email", "s": "ssn", "p": "phone"}


def test_estimates_give_the_same_roles(sales, tables):
    for df in (sales, tables["orders"], tables["documents"].drop("text"), tables["part"]):
        exact = {r["column"]: (r["role"], r["is_key_candidate"], r["is_constant"], r["is_high_cardinality"])
                 for r in inspection.inspect_columns(df).collect()}
        near = {r["column"]: (r["role"], r["is_key_candidate"], r["is_constant"], r["is_high_cardinality"])
                for r in inspection.inspect_columns(df, approx=True).collect()}
        assert near == exact


def test_profiles_of_tiny_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    rows = {r["column"]: r for r in profiling.profile_numeric(df, ["a", "b"]).collect()}
    assert rows["a"]["std"] == 0.0 and rows["a"]["skewness"] == 0.0 and rows["a"]["median"] == 1.0
    assert rows["b"]["status"] == "empty" and rows["b"]["mean"] is None


def test_quality_of_a_clean_table(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(20)], "a int, b double")
    assert profiling.quality_score(df).first()["quality_score"] == 100.0


def test_flat_deviation_has_no_mad_outliers(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(50.0,)], "v double")
    assert exploration.anomaly_mad(df, ["v"]).first()["mad_outlier_count"] == 0


def test_few_values_have_no_anomalies(spark):
    df = spark.createDataFrame([(1.0,), (99.0,)], "v double")
    assert exploration.anomaly_iqr(df, ["v"]).count() == 0


def test_correlation_needs_three_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "a double, b double")
    assert exploration.corr_pearson(df, ["a", "b"]).first()["pearson"] is None


def test_wide_correlation_equals_pairs(spark, tables, monkeypatch):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    narrow = exploration.corr_pearson(tables["lineitem"], cols).orderBy("var1", "var2").collect()
    monkeypatch.setattr(exploration, "WIDE", 2)
    assert exploration.corr_pearson(tables["lineitem"], cols).orderBy("var1", "var2").collect() == narrow


def test_growth_from_zero(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp'2025-01-01', 0.0D), (timestamp'2025-01-03', 5.0D) AS t(d, v)")
    row = exploration.trend_growth(df, "d", ["v"]).first()
    assert (row["periods"], row["absolute_change"], row["percentage_growth"]) == (3, 5.0, 0.0)


def test_short_series_has_no_forecast(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp'2025-01-01', 1.0D), (timestamp'2025-01-03', 5.0D) AS t(d, v)")
    assert forecast.forecast(df, "d", "v").count() == 0


def test_forecast_follows_an_exact_line(spark):
    df = spark.range(10).select(F.date_add(F.lit("2025-01-01"), F.col("id").cast("int")).alias("d"), (F.col("id") * 3.0).alias("v"))
    rows = forecast.forecast(df, "d", "v", 2).orderBy("step").collect()
    assert [(str(r["period"]), r["forecast"]) for r in rows] == [("2025-01-11", 30.0), ("2025-01-12", 33.0)]
    fit = forecast.forecast_summary(df, "d", "v").first()
    assert fit["trend_direction"] == "Upward" and fit["r_squared"] == 1.0


def test_month_labels_and_steps(spark):
    df = spark.sql("""SELECT * FROM VALUES (timestamp'2024-11-05', 1.0D), (timestamp'2024-12-31', 2.0D), (timestamp'2025-02-01', 3.0D),
      (timestamp'2025-02-03', 3.0D) AS t(d, v)""")
    periods = [str(r[0]) for r in exploration.period_totals(df, "d", ["v"]).orderBy("period").select("period").collect()]
    assert periods == ["2024-11-30", "2024-12-31", "2025-01-31", "2025-02-28"]
    assert str(forecast.forecast(df, "d", "v", 1).first()["period"]) == "2025-03-28"


def test_falling_forecast_stops_at_zero(spark):
    df = spark.range(5).select(F.date_add(F.lit("2025-01-01"), F.col("id").cast("int")).alias("d"), (8.0 - F.col("id") * 2).alias("v"))
    assert {r["forecast"] for r in forecast.forecast(df, "d", "v", 3).collect()} == {0.0}


def test_welch_needs_two_levels_and_three_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 1.0), ("b", 2.0)], "g string, v double")
    assert hypothesis.welch_t(df, ["g"], ["v"]).count() == 0


def test_chi_square_counts_cells_that_never_occur(spark):
    df = spark.createDataFrame([("a", "x")] * 6 + [("b", "y")] * 6 + [("c", "y")] * 6, "p string, q string")
    assert hypothesis.chi_square(df, ["p", "q"]).first()["statistic"] == pytest.approx(18.0)


def test_yates_on_a_table_with_an_empty_cell(spark):
    df = spark.createDataFrame([("a", "x")] * 5 + [("a", "y")] * 3 + [("b", "y")] * 4, "p string, q string")
    n, o = 12, {("a", "x"): 5, ("a", "y"): 3, ("b", "x"): 0, ("b", "y"): 4}
    r, c = {"a": 8, "b": 4}, {"x": 5, "y": 7}
    want = sum((max(0, abs(v - r[i] * c[j] / n) - 0.5)) ** 2 / (r[i] * c[j] / n) for (i, j), v in o.items())
    assert hypothesis.chi_square(df, ["p", "q"]).first()["statistic"] == pytest.approx(want)


def test_one_level_is_no_table(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y")], "p string, q string")
    assert hypothesis.chi_square(df, ["p", "q"]).count() == 0


def test_kpi_roles():
    roles = kpi.resolve_roles(["Order_ID", "Customer_ID", "Qty", "Price", "Amount"], ["Qty", "Price", "Amount"])
    assert roles == {"revenue": "Price", "units": "Qty", "customer": "Customer_ID"}
    assert kpi.resolve_roles(["a"], ["a"], {"revenue": "a"}) == {"revenue": "a"}


def test_kpis_of_nothing(spark):
    df = spark.createDataFrame([], "customer_id string, returned string")
    assert kpi.kpi_returns(df, "returned").first()["return_rate"] == 0.0
    assert kpi.kpi_customers(df, "customer_id").first()["repeat_rate"] == 0.0


def test_problem_type(tables):
    assert modeling.problem_type(tables["orders"], "o_orderstatus") == "classification"
    assert modeling.problem_type(tables["labels"], "quality") == "classification"
    assert modeling.problem_type(tables["orders"], "o_totalprice") == "regression"


def test_untrainable_tables(spark):
    with pytest.raises(modeling.NotTrainable):
        modeling.train_baseline(spark.createDataFrame([(1.0, 2.0)] * 5, "a double, b double"), "b")
    with pytest.raises(modeling.NotTrainable):
        modeling.train_baseline(spark.createDataFrame([(float(i), "x") for i in range(30)], "a double, b string"), "b")


def test_model_finds_the_signal(spark):
    df = spark.createDataFrame([(float(i % 40), "uv"[i % 2], "yes" if i % 40 > 20 else "no") for i in range(400)],
                               "a double, c string, y string")
    fit = modeling.train_baseline(df, "y")
    metrics = {r["metric"]: r["value"] for r in fit.metrics.collect()}
    assert metrics["accuracy"] > 0.95 and metrics["roc_auc"] > 0.95
    assert metrics["train_rows"] + metrics["test_rows"] == 400
    assert fit.importance.first()["feature"] == "a"


def test_many_levels_are_hashed_not_dropped(spark):
    df = spark.createDataFrame([(f"k{i}", float(i % 5), float(i)) for i in range(300)], "name string, a double, y double")
    fit = modeling.train_baseline(df, "y", "regression")
    assert "name" in {r["feature"] for r in fit.importance.collect()}


def test_one_encoding_at_every_size(spark):
    for n in (60, 600):
        df = spark.createDataFrame([(f"k{i}", float(i % 5), float(i)) for i in range(n)], "name string, a double, y double")
        model = modeling.train_baseline(df, "y", "regression", width=64).model
        assert [type(x).__name__ for x in model.stages] == [
            "ImputerModel", "FeatureHasher", "VectorAssembler", "VarianceThresholdSelectorModel", "RandomForestRegressionModel"]
        assert 2 < model.stages[-1].numFeatures <= 65
    with pytest.raises(modeling.NotTrainable):
        modeling.train_baseline(spark.createDataFrame([("k", float(i)) for i in range(40)], "name string, y double"), "y", "regression")


def test_the_test_quarter_is_exact_in_each_class(spark):
    rows = [(f"c{k}", i) for k, n in enumerate((1, 4, 5, 400)) for i in range(n)] + [(None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "y string, v int")
    found = {r["y"]: (r["n"], r["t"]) for r in modeling.test_quarter(df, ["y"]).groupBy("y").agg(
        F.count("*").alias("n"), F.count_if("_test").alias("t")).collect()}
    assert found == {"c0": (1, 1), "c1": (4, 1), "c2": (5, 2), "c3": (400, 100), None: (2, 1)}
    copies = modeling.test_quarter(spark.range(1000).selectExpr("'x' AS y"), []).where("_test")
    assert copies.count() == copies.count() == 250


def test_the_forest_deals_the_rows_of_one_block_among_tasks(spark, monkeypatch):
    held, stages = [], modeling.feature_stages

    def seen(frame, *more):
        held.append(sorted(r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()))
        return stages(frame, *more)

    monkeypatch.setattr(modeling, "feature_stages", seen)
    monkeypatch.setattr(modeling, "TASK_BYTES", 100_000, raising=False)
    df = spark.range(0, 400, 1, 1).selectExpr("concat('k', id % 7) AS name", "id % 40 AS a", "id * 1.0 AS y", "id % 40 > 20 AS b")
    for target, tested in (("y", 100), ("b", 101)):
        fit = modeling.train_baseline(df, target)
        assert sum(held[-1]) == 400 and len(held[-1]) >= 4 and held[-1][-1] < 150
        assert {r["metric"]: r["value"] for r in fit.metrics.collect()}["test_rows"] == tested


@pytest.fixture
def unforced(spark):
    """Spark broadcasts only what the code tells it to, as with large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_split_brings_no_class_into_one_task(spark, unforced):
    df = spark.range(0, 4000, 1, 8).selectExpr("IF(id < 10, 'few', 'many') AS y", "id")
    rows = modeling.test_quarter(df, ["y"])
    assert [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()] == [500] * 8
    assert {r["y"]: r["n"] for r in rows.where("_test").groupBy("y").agg(F.count("*").alias("n")).collect()} == {"few": 3, "many": 998}


def test_box_rows_are_not_sorted_by_group(spark, unforced):
    df = spark.range(0, 400, 1, 4).selectExpr("IF(id < 20, NULL, 'many') AS g", "IF(id = 399, 9999.0, id * 1.0) AS v")
    box = charts.box_stats(df, "g", "v")
    assert {r["g"]: (r["n"], r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"], r["outliers"]) for r in box.collect()} == {
        None: (20, 4.75, 9.5, 14.25, 0.0, 19.0, 0), "many": (380, 114.75, 209.5, 304.25, 20.0, 398.0, 1)}
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_metrics_in_one_pass_are_those_of_the_evaluators(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    scored = spark.createDataFrame([(float(i % 3), float((i * i) % 4 % 3)) for i in range(50)], "label double, prediction double")
    found = modeling._metrics(scored, "classification", 3)
    names = {"accuracy": "accuracy", "precision": "weightedPrecision", "recall": "weightedRecall", "f1_score": "f1"}
    assert found == pytest.approx({k: MulticlassClassificationEvaluator(metricName=m).evaluate(scored) for k, m in names.items()})
    assert modeling._metrics(scored, "regression", 0) == pytest.approx(
        {m: RegressionEvaluator(metricName=m).evaluate(scored) for m in ("mae", "rmse", "r2")})


def test_chart_rules(sales):
    kinds = [r["chart"] for r in charts.recommend_charts(sales, inspection.table_meta(sales)).collect()]
    assert kinds == ["line", "bar", "scatter", "box", "heatmap", "donut"]


def test_histogram_keeps_empty_bins_and_the_top_edge(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.0,)], "v double")
    assert [r["count"] for r in charts.histogram(df, "v", 5).orderBy("bin").collect()] == [1, 0, 0, 0, 2]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert charts.histogram(flat, "v", 4).agg(F.sum("count")).first()[0] == 2


def test_a_table_without_rows(spark):
    df = spark.createDataFrame([], "a string, b double, c timestamp")
    rows = inspection.inspect_columns(df).collect()
    assert sorted((r["column"], r["inferred_type"], r["total_count"]) for r in rows) == [
        ("a", "empty", 0), ("b", "empty", 0), ("c", "empty", 0)]
    assert inspection.missing_by_column(df).count() == 3
    assert inspection.duplicate_rows(df).first()["duplicate_pct"] == 0.0
    assert profiling.profile_numeric(df, ["b"]).first()["status"] == "empty"
    assert cleaning.clean(df, inspection.table_meta(df)).log.count() == 0


def test_keys_and_constants_without_counting_all_values(spark):
    rows = [(i, i if i != 7 else 8, float("nan") if i % 2 else 5.0, None, f"k{i}", None if i == 3 else i) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, near int, c double, gone string, k string, gap int")
    assert sorted(r["column"] for r in inspection.pk_candidates(df).collect()) == ["a", "k"]
    assert inspection.pk_candidates(df.limit(0)).count() == 0
    assert {r["column"] for r in inspection.constant_columns(df).collect() if r["is_constant"]} == {"c", "gone"}
    by_counts = {r["column"]: r["is_constant"] for r in inspection.inspect_columns(df).collect()}
    assert {r["column"]: r["is_constant"] for r in inspection.quality_facts(df).collect()} == by_counts
