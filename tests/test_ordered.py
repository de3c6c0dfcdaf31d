import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from datalumen.operators.ordered import average_ranks, framed, numbered, ranked, tiles
from datalumen.operators import quantiles as narrowing
from datalumen.operators.quantiles import quantiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    # one group holds more than a third of the rows, and one has a null key
    data = [(i, ("hot" if i % 2 else None if i % 7 == 0 else f"g{i % 5}"), float(rng.randint(0, 60)) / 4) for i in range(900)]
    return spark.createDataFrame(data, "id bigint, g string, v double")


def same(a, b):
    assert a.columns == b.columns
    key = lambda r: tuple(str(x) for x in r)
    left = sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in a.collect()], key=key)
    right = sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in b.collect()], key=key)
    assert left == right


@pytest.mark.parametrize("by", [[], ["g"]])
def test_numbered_slices_equal_window(rows, by):
    order = [F.desc("v"), F.asc("id")]
    same(numbered(rows, by, order, sums={"run": "v"}, limit=50), numbered(rows, by, order, sums={"run": "v"}))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_framed_blocks_equal_window(rows, by):
    exprs = {
        "prev": lambda w: F.lag("id").over(w), "nxt": lambda w: F.lead("id", 2).over(w),
        "ma": lambda w: F.avg("v").over(w.rowsBetween(-6, 2)),
    }
    order = [F.asc("v"), F.asc("id")]
    same(framed(rows, by, order, exprs, 6, 2, limit=40), framed(rows, by, order, exprs, 6, 2))


def test_ranked_equals_window_functions(rows):
    w = Window.partitionBy("g").orderBy("v")
    plain = rows.select("*", F.rank().over(w).cast("bigint").alias("rank"), F.dense_rank().over(w).cast("bigint").alias("dense_rank"),
                        F.percent_rank().over(w).alias("percent_rank"), F.cume_dist().over(w).alias("cume_dist"))
    same(ranked(rows, ["g"], "v", limit=20).drop("average_rank").select(*plain.columns), plain)


@pytest.mark.parametrize("n", [1, 4, 7])
def test_tiles_equal_ntile(rows, n):
    order = [F.desc("v"), F.asc("id")]
    plain = rows.withColumn("tile", F.ntile(n).over(Window.orderBy(*order)).cast("bigint"))
    same(tiles(rows, n, order, limit=70), plain)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_by_position_equal_percentile(rows, by):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    data = rows.withColumn("w", F.when(F.col("id") % 3 == 0, F.col("v") * F.col("v")))
    sliced = quantiles(data, ["v", "w"], probs, by, limit=15)
    plain = quantiles(data, ["v", "w"], probs, by)
    flat = lambda d: d.select(*by, *[F.round(F.col(c)[i], 9).alias(f"{c}{i}") for c in ("v", "w") for i in range(len(probs))])
    same(flat(sliced), flat(plain))
    assert not math.isnan(flat(plain).first()[len(by)])


@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles_by_narrowing_equal_percentile(rows, by, monkeypatch):
    monkeypatch.setattr(narrowing, "PICK", 4)
    monkeypatch.setattr(narrowing, "SPLITS", 12)
    data = rows.select("g", "v", (F.col("v") * 3 - 7).alias("w")).union(rows.select("g", F.lit(2.5), F.lit(1.0)))
    data = data.union(data).union(data).union(data)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    same(quantiles(data, ["v", "w"], probs, by, limit=15), quantiles(data, ["v", "w"], probs, by))


def test_estimated_quantiles_are_near(rows):
    exact = quantiles(rows, ["v"], [0.25, 0.5], ["g"]).orderBy("g").collect()
    near = quantiles(rows, ["v"], [0.25, 0.5], ["g"], accuracy=10_000).orderBy("g").collect()
    assert all(abs(a["v"][i] - b["v"][i]) <= 0.25 for a, b in zip(exact, near) for i in (0, 1))


def test_average_rank_of_both_ways(rows):
    few = ranked(rows, [], "v", limit=20).select("id", "average_rank")
    same(few, ranked(rows, [], "v").select("id", "average_rank"))


def test_average_ranks_shuffle_rows_once_for_each_column_of_many_values(spark):
    odd = [0.0, -0.0, 1e300, float("inf"), float("-inf"), 2.5, 2.5, -7.0]
    df = spark.createDataFrame([(float(i % 3), odd[i % 8] if i % 5 else float(i), float(i * 7919 % 1000)) for i in range(1000)],
                               "`a.b` double, b double, c double")
    names = ["`a.b`", "b", "c"]
    want = sorted(map(tuple, average_ranks(df, df.columns).collect()))
    for limit in (20, 300, 999):
        got = average_ranks(df, df.columns, limit=limit)
        assert got.columns == df.columns and sorted(map(tuple, got.select(*names).collect())) == want

    ranks = average_ranks(df, ["a.b"], limit=300)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in ranks
    assert average_ranks(df, df.columns, limit=300)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
