"""Joins on order and on ranges, which Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datalumen.functions.columns import col
from datalumen.operators.ordered import ROWS_PER_TASK, carried
from datalumen.session import checkpointed


def asof_join(
    left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, take: list[str],
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every left row with the latest right row of the same keys at or before its time; null where there is none.

    Both sides are put in one time order and the latest right row is carried forward, so no pairs are
    built. Among right rows of the same instant the greatest values win.
    """
    fields = {c: right.schema[c].dataType for c in take}
    payload = F.struct(*[col(c) for c in take])
    kind = "struct<" + ",".join(f"`{c}`:{t.simpleString()}" for c, t in fields.items()) + ">"
    keys = [col(k) for k in on]
    a = left.select(
        *keys, col(left_time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_right"),
        F.struct(*[col(c) for c in left.columns]).alias("_left"))
    b = right.select(
        *keys, col(right_time).alias("_time"), F.lit(0).alias("_side"), payload.alias("_right"),
        F.lit(None).cast(a.schema["_left"].dataType).alias("_left"))
    line = a.unionByName(b).filter("_time IS NOT NULL")
    order = [F.asc("_time"), F.asc("_side"), F.asc("_right"), F.asc("_left")]
    found = carried(line, on, order, "_right", "_match", limit).filter("_side = 1")
    return found.select("_left.*", *[F.col("_match")[c].alias(c) for c in take])


#: Points of one cell that are met in one task, cells above that which are broadcast, and the level whose one cell holds everything.
CELL_ROWS, HOT_CELLS, TOP = 1_000_000, 100_000, 60


def range_join(
    points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: float | None = None,
) -> DataFrame:
    """Points with every interval that holds them, ``low <= point <= high``.

    Cells of level k are ``width * 2**k`` wide. An interval is listed at the level of its own length, where it touches at most two or
    three cells, whatever its length; a point is listed once for each level that occurs. So no interval is spread over many cells,
    and a point is compared only with intervals that start or end within their own length of it. Cells with more than
    ``CELL_ROWS`` points are dealt to several tasks, each with the cell's intervals. Without ``width`` it is the median length
    of the intervals. Rows with a null point, low or high meet nothing, nor do intervals that end before they start.
    """
    start, stop, at = (c.cast("double") for c in (col(low), col(high), col(point)))
    spans = intervals.filter(col(low) <= col(high))
    if width is None:
        middle = spans.agg(F.percentile_approx(stop - start, 0.5)).first()[0]
        width = middle if middle and 0 < middle < float("inf") else 1.0

    def cell(c: Column, level: Column) -> Column:
        number = F.floor(c / (F.lit(float(width)) * F.pow(F.lit(2.0), level)))
        return F.when(level >= TOP, F.lit(0)).otherwise(F.greatest(F.least(number, F.lit(1 << 62)), F.lit(-1 << 62)))

    length = (stop - start) / F.lit(float(width))
    level = F.when(~(length < 2.0 ** TOP), F.lit(TOP)).otherwise(F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1.0)))))).cast("int")
    spans = spans.withColumn("_level", level)
    first, last = cell(start, F.col("_level")), cell(stop, F.col("_level"))
    spans = spans.withColumn("_cell", F.explode(F.array_distinct(F.array(first, F.least(first + 1, last), last))))
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())  # at most TOP + 1
    each = F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>"))
    places = points.filter(at.isNotNull()).withColumn("_level", each).withColumn("_cell", cell(at, F.col("_level")))

    keys = ["_level", "_cell"]
    hot = checkpointed(places.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > CELL_ROWS).withColumn(
        "_tasks", F.ceil(F.col("_n") / CELL_ROWS).cast("int")).drop("_n"))
    some = hot.count()
    if some:
        hot = F.broadcast(hot) if some <= HOT_CELLS else hot
        tasks = F.coalesce("_tasks", F.lit(1))
        spans = spans.join(hot, keys, "left").withColumn("_task", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("_tasks")
        places = places.join(hot, keys, "left").withColumn("_task", F.floor(F.rand(7) * tasks).cast("int")).drop("_tasks")
        keys = [*keys, "_task"]
    return places.join(spans, keys).filter(col(point).between(col(low), col(high))).drop(*keys)
