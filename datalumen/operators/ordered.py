"""Positions, running totals and row frames that stay exact when one group is far too big for a task.

Groups that a count shows to be small use Spark's window functions as they are. Otherwise the rows are
range-partitioned into slices, each slice is numbered by itself, and the totals of the slices before it
are added: no task sees more than a slice.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, inf, isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from datalumen.functions.columns import col, join_null_safe
from datalumen.session import checkpointed

ROWS_PER_TASK = 2_000_000


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Row count of the biggest group (of the whole frame without keys)."""
    if not by:
        return df.count()
    return df.groupBy(*[col(k) for k in by]).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def small_groups(df: DataFrame, by: list[str], limit: int, known: int | None = None) -> bool:
    """Whether every group fits one task, by a bound the caller knows or else by counting."""
    return (known is not None and known <= limit) or largest_group(df, by) <= limit


def _sliced(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """The rows in ordered slices of about half the limit, written down so that every reader sees the same slices."""
    slices = max(2, ceil(2 * df.count() / limit))
    ranged = df.repartitionByRange(slices, *[col(k) for k in by], *order)
    return checkpointed(ranged.withColumn("_slice", F.spark_partition_id()))


def numbered(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    name: str = "rn",
    sums: dict[str, str] | None = None,
    limit: int = ROWS_PER_TASK,
    known: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group and running totals ``{new column: measure}``.

    ``order`` must leave no ties, so that slices can split every group. A ``known`` bound on the size of
    the groups saves the count.
    """
    sums = sums or {}
    if small_groups(df, by, limit, known):
        window = Window.partitionBy(*[col(k) for k in by]).orderBy(*order)
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = df.withColumn(name, F.row_number().over(window).cast("bigint"))
        return out.withColumns({new: F.sum(col(m)).over(upto) for new, m in sums.items()})

    sliced = _sliced(df, by, order, limit)
    keys = [*by, "_slice"]
    totals = sliced.groupBy(*[col(k) for k in keys]).agg(
        F.count("*").alias("_rows"), *[F.sum(col(m)).alias(f"_sum_{new}") for new, m in sums.items()]
    )
    before = Window.partitionBy(*[col(k) for k in by]).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ["_rows", *[f"_sum_{new}" for new in sums]]
    offsets = totals.select(
        *[col(k) for k in keys], F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"),
        *[F.sum(c).over(before).alias(c) for c in carried[1:]]
    )
    within = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.withColumn(name, F.row_number().over(within).cast("bigint"))
    local = local.withColumns({new: F.sum(col(m)).over(upto) for new, m in sums.items()})
    joined = join_null_safe(local, offsets, keys)
    moved = {name: F.col(name) + F.col("_rows")} | {
        # A total stays null only until the first value of the group, wherever the slices are cut.
        new: F.coalesce(F.col(new) + F.col(f"_sum_{new}"), F.col(new), F.col(f"_sum_{new}")) for new in sums}
    return joined.withColumns(moved).drop("_slice", *carried)


def carried(
    df: DataFrame, by: list[str], order: list[Column], value: str, name: str, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Add the latest non-null ``value`` up to and including each row of its group."""
    if largest_group(df, by) <= limit:
        window = Window.partitionBy(*[col(k) for k in by]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(col(value), ignorenulls=True).over(window))
    sliced = _sliced(df, by, order, limit)
    keys = [*by, "_slice"]
    within = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
    local = sliced.withColumn("_rn", F.row_number().over(within)).withColumn(
        "_here", F.last(col(value), ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy(*[col(k) for k in keys]).agg(F.max_by("_here", "_rn").alias("_end"))
    earlier = Window.partitionBy(*[col(k) for k in by]).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(*[col(k) for k in keys], F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    joined = join_null_safe(local, offsets, keys)
    return joined.withColumn(name, F.coalesce("_here", "_before")).drop("_slice", "_rn", "_here", "_before")


def framed(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    exprs: dict[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Window expressions that look at most ``before`` rows back and ``after`` rows ahead (lag, moving averages).

    Big groups are cut into blocks of ``limit`` rows, and the rows next to a block's edge are copied to
    its neighbour, so every frame is complete inside one block.
    """
    if largest_group(df, by) <= limit:
        window = Window.partitionBy(*[col(k) for k in by]).orderBy(*order)
        return df.withColumns({new: make(window) for new, make in exprs.items()})
    placed = numbered(df, by, order, "_rn", limit=limit)
    size = max(limit, before, after, 1)
    block = F.floor((F.col("_rn") - 1) / size).cast("bigint")
    offset = F.pmod(F.col("_rn") - 1, F.lit(size))
    homes = F.array_compact(
        F.array(
            F.struct(block.alias("block"), F.lit(True).alias("own")),
            F.when(offset >= size - before, F.struct((block + 1).alias("block"), F.lit(False).alias("own"))),
            F.when((offset < after) & (block > 0), F.struct((block - 1).alias("block"), F.lit(False).alias("own"))),
        )
    )
    copies = placed.withColumn("_home", F.explode(homes))
    copies = copies.withColumn("_block", F.col("_home.block")).withColumn("_own", F.col("_home.own"))
    window = Window.partitionBy(*[col(k) for k in by], "_block").orderBy("_rn")
    out = copies.withColumns({new: make(window) for new, make in exprs.items()})
    return out.filter("_own").drop("_rn", "_home", "_block", "_own")


def ranked(
    df: DataFrame, by: list[str], value: str, descending: bool = False, limit: int = ROWS_PER_TASK,
    known: int | None = None,
) -> DataFrame:
    """Add rank, dense_rank, percent_rank, cume_dist and the average rank of ``value`` within ``by``.

    Beyond the size of a task the ranks are worked out once per distinct value and joined back.
    """
    if small_groups(df, by, limit, known):
        return _ranked_by_window(df, by, value, descending)
    counts = checkpointed(df.groupBy(*[col(k) for k in by], col(value)).agg(F.count("*").alias("_n")))
    order = [col(value).desc() if descending else col(value).asc()]
    placed = numbered(counts, by, order, "_dense", {"_upto": "_n"}, limit)
    totals = counts.groupBy(*[col(k) for k in by]).agg(F.sum("_n").alias("_total"))
    placed = join_null_safe(placed, totals, by) if by else placed.withColumn("_total", totals.scalar())
    rank = F.col("_upto") - F.col("_n") + 1
    table = placed.select(
        *[col(k) for k in by],
        col(value),
        rank.alias("rank"),
        F.col("_dense").alias("dense_rank"),
        F.coalesce(F.try_divide((rank - 1).cast("double"), F.col("_total") - 1), F.lit(0.0)).alias("percent_rank"),
        (F.col("_upto").cast("double") / F.col("_total")).alias("cume_dist"),
        (rank + (F.col("_n") - 1) / 2.0).alias("average_rank"),
    )
    return join_null_safe(df, table, [*by, value])


def _ranked_by_window(df: DataFrame, by: list[str], value: str, descending: bool) -> DataFrame:
    keys = [col(k) for k in by]
    window = Window.partitionBy(*keys).orderBy(col(value).desc() if descending else col(value).asc())
    total = F.count("*").over(Window.partitionBy(*keys))
    out = df.select(
        *[col(c) for c in df.columns], F.rank().over(window).cast("bigint").alias("rank"),
        F.dense_rank().over(window).cast("bigint").alias("dense_rank"), F.percent_rank().over(window).alias("percent_rank"),
        F.cume_dist().over(window).alias("cume_dist"), total.alias("_total"))
    upto = F.round(F.col("cume_dist") * F.col("_total"))
    return out.withColumn("average_rank", (F.col("rank") + upto) / 2.0).drop("_total")


def average_ranks(df: DataFrame, columns: list[str], limit: int = ROWS_PER_TASK, known: int | None = None) -> DataFrame:
    """The columns, doubles without nulls, with each value replaced by its average rank in its column.

    Beyond the size of a task the values of each column fall into the spaces between estimated splits, or on a split itself. Counts of these,
    for all columns in one pass, give the rank of every value that is a split, and what precedes the others. Only for those the rows are
    shuffled, once for each column, and ranked within their space; rows on a split, which may be very many, are dealt by their hash.
    """
    rows = df.count() if known is None else known
    if rows <= limit:
        for c in columns:
            df = ranked(df, [], c, limit=limit, known=rows).withColumn(f"_rank_{c}", F.col("average_rank")).drop(
                "rank", "dense_rank", "percent_rank", "cume_dist", "average_rank")
        return df.select(*[col(f"_rank_{c}").alias(c) for c in columns])
    parts = ceil(2 * rows / limit)
    names = [f"_v{i}" for i in range(len(columns))]
    # Adding zero makes one value of 0.0 and -0.0.
    df = df.select(*[(col(c) + F.lit(0.0)).alias(v) for c, v in zip(columns, names)])
    picked = df.agg(*[F.percentile_approx(v, [i / parts for i in range(1, parts)], 10 * parts).alias(v) for v in names]).first()
    splits = [[-inf, *(sorted({x for x in picked[v] if isfinite(x)}) or [0.0]), inf] for v in names]
    cut = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"_b{i}" for i in range(len(names))])

    def places() -> list[Column]:
        """Per column, twice the number of the split at or below the value, and one more beyond the split itself."""
        found = [F.col(f"_b{i}").cast("int") for i in range(len(names))]
        return [2 * b + F.when(F.col(v) == F.get(F.lit(s), b), 0).otherwise(1) for v, s, b in zip(names, splits, found)]

    cells = [F.struct(F.lit(i).alias("column"), p.alias("place")) for i, p in enumerate(places())]
    held = {(r["column"], r["place"]): r["count"] for r in cut.transform(df).select(
        F.inline(F.array(*cells))).groupBy("column", "place").count().collect()}
    for i, v in enumerate(names):
        counts = [held.get((i, p), 0) for p in range(2 * len(splits[i]))]
        before = [0]
        for n in counts:
            before.append(before[-1] + n)
        one = Bucketizer(splits=splits[i], inputCol=v, outputCol=f"_b{i}")
        placed = one.transform(df).select(*names, places()[i].alias("_place"))
        at = F.get(F.lit([float(b) if p % 2 else b + (n + 1) / 2 for p, (b, n) in enumerate(zip(before, counts))]), F.col("_place"))
        if any(counts[1::2]):
            open_ = F.col("_place") % 2 == 1
            salt = F.when(open_, 0).otherwise(F.pmod(F.xxhash64(*names), F.lit(parts)))
            # A fixed number of tasks: repeated values are small when packed, and would be brought together by their bytes.
            placed = placed.select(*names, (F.col("_place") * F.lit(parts) + salt).alias("_part")).repartition(2 * parts, "_part")
            near = F.rank().over(Window.partitionBy("_part").orderBy(v)) + (F.count("*").over(Window.partitionBy("_part", v)) - 1) / 2
            placed = placed.withColumn("_near", near).withColumn("_place", F.floor(F.col("_part") / parts).cast("int"))
            at = at + F.when(open_, F.col("_near")).otherwise(0.0)
        df = placed.select(*[at.alias(v) if n == v else n for n in names])
    return df.select(*[F.col(v).alias(c) for c, v in zip(columns, names)])


def tiles(df: DataFrame, n: int, order: list[Column], name: str = "tile", limit: int = ROWS_PER_TASK) -> DataFrame:
    """NTILE over the whole frame: the first ``rows mod n`` tiles hold one row more than the others."""
    total = df.count()
    size, extra = divmod(total, n)
    placed = numbered(df, [], order, "_rn", limit=limit, known=total)
    zero = F.col("_rn") - 1
    edge = extra * (size + 1)
    early = F.floor(zero / (size + 1)) + 1
    late = F.floor((zero - edge) / max(size, 1)) + 1 + extra
    return placed.withColumn(name, F.when(zero < edge, early).otherwise(late).cast("bigint")).drop("_rn")
