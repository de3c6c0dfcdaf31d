import random

import pytest
from pyspark.sql import functions as F

from datalumen.operators import joins
from datalumen.operators.joins import asof_join, range_join
from datalumen.operators.rows import slice_rows
from datalumen.plans.templates import neighbours


@pytest.mark.parametrize("limit", [30, 1_000_000])
def test_asof_equals_brute_force(spark, limit):
    rng = random.Random(2)
    left = [(i, "hot" if i % 2 else f"k{i % 4}", rng.randint(0, 500)) for i in range(150)]
    right = [("hot" if i % 3 else f"k{i % 3}", 7 * i % 501, i) for i in range(120)]
    a = spark.createDataFrame(left, "id int, k string, t int")
    b = spark.createDataFrame(right, "k string, t int, v int")
    got = {r["id"]: r["v"] for r in asof_join(a, b, ["k"], "t", "t", ["v"], limit).collect()}
    want = {}
    for i, k, t in left:
        before = [(rt, v) for rk, rt, v in right if rk == k and rt <= t]
        want[i] = max(before)[1] if before else None
    assert got == want


def test_range_join_equals_brute_force(spark):
    rng = random.Random(3)
    points = [(i, 5.0 if i % 3 == 0 else rng.uniform(-20, 20)) for i in range(120)]
    spans = [(j, lo, lo + rng.choice([-1.0, 0.0, 0.5, 9.0])) for j in range(25) for lo in [rng.uniform(-25, 20)]] + [(99, 5.0, 5.0)]
    got = range_join(spark.createDataFrame(points, "i int, p double"), spark.createDataFrame(spans, "j int, lo double, hi double"),
                     "p", "lo", "hi", 2.0).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, p in points for j, lo, hi in spans if lo <= p <= hi)


@pytest.mark.parametrize("width, most", [(None, 1_000_000), (0.5, 20), (100.0, 20)])
def test_range_join_with_wide_intervals_and_hot_cells(spark, monkeypatch, width, most):
    monkeypatch.setattr(joins, "CELL_ROWS", most)
    rng = random.Random(4)
    points = [(i, 5.0 if i % 3 == 0 else rng.uniform(-2000, 2000)) for i in range(200)] + [(500, None), (501, float("inf")), (502, 5.0)]
    spans = [(j, lo, lo + 2.0 ** rng.randint(-6, 11)) for j in range(60) for lo in [rng.uniform(-2500, 2000)]]
    spans += [(90, -1e300, 1e300), (91, float("-inf"), float("inf")), (92, 5.0, 5.0), (93, None, 1.0), (94, 0.0, None), (95, 4.0, 3.0), (96, -4.0, 12.0)]
    joined = range_join(spark.createDataFrame(points, "i int, p double"), spark.createDataFrame(spans, "j int, lo double, hi double"), "p", "lo", "hi", width)
    want = sorted((i, j) for i, p in points for j, lo, hi in spans if None not in (p, lo, hi) and lo <= p <= hi)
    assert sorted(map(tuple, joined.select("i", "j").collect())) == want
    assert joined.columns == ["i", "p", "j", "lo", "hi"]


def test_an_interval_is_listed_in_few_cells(spark):
    points, spans = spark.range(10).selectExpr("double(id) AS p"), spark.createDataFrame([(0.0, 1e9)], "lo double, hi double")
    assert range_join(points, spans, "p", "lo", "hi", 1e-3).count() == 10
    assert range_join(points, spans.limit(0), "p", "lo", "hi").count() == 0


def test_slicer(spark):
    df = spark.createDataFrame([(i, f"c{i % 5}") for i in range(50)], "i int, c string")
    assert slice_rows(df, "c", []).count() == 50
    assert slice_rows(df, "c", ["c1"]).count() == 10
    assert slice_rows(df, "c", ["c1", "c2"] + [f"x{i}" for i in range(1500)]).count() == 20


def test_neighbours(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 60.0)], "t int, v double")
    rows = neighbours(df, [], [F.asc("t")], "v").orderBy("t").collect()
    assert [(r["previous"], r["following"], r["moving_avg"]) for r in rows] == [(None, 20.0, 10.0), (10.0, 60.0, 15.0), (20.0, None, 30.0)]
