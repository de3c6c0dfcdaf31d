"""Limits decide how a result is computed, never what it is."""

from pyspark.sql import functions as F

from datalumen.operators import exploration
from datalumen.operators.ordered import numbered
from datalumen.operators.quantiles import quantiles

VALUES = [(1, 5.0), (2, None), (3, None), (4, 1.0), (5, None), (6, None), (7, None), (8, None), (9, 2.0), (10, None)]


def test_running_totals_carry_over_slices_that_begin_with_nulls(spark):
    rows = [("a", i, v) for i, v in VALUES] + [("b", i, None) for i in range(4)] + [(None, 1, 3.0), (None, 2, None)]
    df = spark.createDataFrame(rows, "g string, i bigint, v double")
    small, large = (numbered(df, ["g"], [F.asc("i")], sums={"total": "v"}, limit=limit) for limit in (100, 2))
    assert sorted(map(str, small.collect())) == sorted(map(str, large.select(*small.columns).collect()))


def test_quantiles_keep_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", None), (None, 2.0), ("c", 7.0)], "g string, v double")
    small, large = (quantiles(df, ["v"], [0.25, 0.5], ["g"], limit) for limit in (100, 1))
    assert sorted(map(str, small.collect())) == sorted(map(str, large.select(*small.columns).collect()))
    assert quantiles(df.limit(0), ["v"], [0.5], ["g"], 1).count() == 0


def test_correlation_is_one_definition_for_few_and_many_columns(spark, monkeypatch):
    schema = "a double, b double, c double"
    tables = [
        [(1.0, 2.0, 0.1), (2.0, 1.0, 0.1), (3.0, 5.0, 0.1), (4.0, 4.0, 0.1)], [(1.0, 2.0, 3.0), (2.0, 1.0, 4.0)], [], [(1.0, None, 2.0)] * 5]
    for rows in tables:
        df = spark.createDataFrame(rows, schema)
        for correlate in (exploration.corr_pearson, exploration.corr_spearman):
            monkeypatch.setattr(exploration, "WIDE", 20)
            few = sorted(map(tuple, correlate(df, ["a", "b", "c"]).collect()), key=str)
            monkeypatch.setattr(exploration, "WIDE", 1)
            many = sorted(map(tuple, correlate(df, ["a", "b", "c"]).collect()), key=str)
            assert few == many
            assert [r[2] for r in few if "c" in r[:2]] == [None, None]


def test_segments_cover_every_column(spark):
    df = spark.createDataFrame([("x", "y", "z", "w", 1, 2, 3, 4)], "a string, b string, c string, d string, m int, n int, o int, p int")
    assert exploration.segment_breakdown(df, list("abcd"), list("mnop")).count() == 16
    assert exploration.segment_top_bottom(df, list("abcd"), list("mnop")).count() == 16


def test_rows_that_differ_in_a_map_only_are_kept(spark):
    from datalumen.operators.cleaning import clean_dedup
    from datalumen.operators.inspection import duplicate_rows
    df = spark.sql("""SELECT * FROM VALUES (1, map('a', 1, 'b', 2), array(map('x', 1))), (1, map('b', 2, 'a', 1), array(map('x', 1))),
                      (1, map('a', 9), array(map('x', 1))), (1, map('a', 9), array(map('x', 2))), (1, NULL, NULL) AS t(i, m, n)""")
    assert clean_dedup(df).count() == 4 and clean_dedup(df).columns == df.columns
    row = duplicate_rows(df).first()
    assert (row.num_rows, row.duplicate_rows) == (5, 1)


def test_text_with_some_numbers_can_be_filled(spark):
    from datalumen.functions.columns import formatted_number
    from datalumen.operators.cleaning import _fill
    df = spark.createDataFrame([("12e3",), ("abc",), (None,)], "v string")
    assert [r.v for r in _fill(df, {"v": 5.0}).collect()] == [12000.0, 5.0, 5.0]
    texts = {".5": 0.5, "5.": 5.0, "1e5": 1e5, "$-5": -5.0, "1 234": 1234.0, "1 23": None, "TX1": None, "(12)": -12.0, "1,200.5 %": 1200.5}
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", formatted_number(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in found} == texts
