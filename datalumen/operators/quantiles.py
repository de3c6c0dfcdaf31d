"""Exact interpolated quantiles for any group size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.functions.columns import col, hits, join_null_safe, measure
from datalumen.operators.ordered import small_groups
from datalumen.session import checkpointed

# Values that the exact percentiles of one group may hold in memory, over all columns.
VALUES_PER_TASK = 4_000_000


#: Values of one quantile's bracket that are taken up at last, and splits per round; a split is wrong by at most a tenth of their distance.
PICK, SPLITS = 100_000, 1000
#: Brackets that are broadcast to the rows; beyond that Spark joins them by its own choice.
BRACKETS = 100_000


def _narrowed(long: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """``_at``, the value of ``_value`` at each rank ``_target`` (the lower and the upper one of each probability) of each group."""
    keys, few = [*by, "_target"], max(PICK, 20 * SPLITS)
    names = [col(k) for k in keys]
    rows, on, done = long, by, []
    while True:
        held = rows.groupBy(*[col(k) for k in on]).agg(
            F.count("*").alias("_n"), F.percentile_approx("_value", [i / SPLITS for i in range(SPLITS + 1)], 10 * SPLITS).alias("_splits"),
            *([] if on == by else [F.first("_rank").alias("_rank")]))
        if on == by:
            place = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
            targets = [F.struct(F.lit(2 * i + k).alias("_target"), r.alias("_rank")) for i, p in enumerate(place) for k, r in enumerate((F.floor(p), F.ceil(p)))]
            held = held.select("*", F.inline(F.array(*targets)))
        # Few rows are taken as they are; else those between two splits around the rank.
        at, whole = F.floor(F.col("_rank") * SPLITS / F.col("_n")).cast("int"), F.col("_n") <= few
        low, high = F.when(~whole & (at >= 1), F.get("_splits", at - 1)), F.when(~whole & (at + 2 <= SPLITS), F.get("_splits", at + 2))
        brackets = checkpointed(held.select(*names, "_rank", low.alias("_low"), high.alias("_high")))
        small = brackets.count() <= BRACKETS
        rows = rows.select(*[col(k) for k in on], "_value")
        met = join_null_safe(rows, F.broadcast(brackets) if small else brackets, on)
        below, least = F.col("_value") < F.col("_low"), F.col("_value") == F.col("_low")
        inside = F.coalesce(F.col("_value") > F.col("_low"), F.lit(True)) & F.coalesce(F.col("_value") < F.col("_high"), F.lit(True))
        counts = checkpointed(met.groupBy(*names).agg(
            *[F.first(c).alias(c) for c in ("_rank", "_low", "_high")], hits(below).alias("_below"), hits(least).alias("_least"), hits(inside).alias("_inside")))
        left = F.col("_rank") - F.col("_below") - F.col("_least")
        counts = counts.withColumn("_left", left)
        done.append(counts.where("_left < 0 OR _left >= _inside").select(*names, F.when(F.col("_left") < 0, F.col("_low")).otherwise(F.col("_high")).alias("_at")))
        open_ = counts.where("_left >= 0 AND _left < _inside").select(*names, F.col("_left").alias("_rank"), "_low", "_high", "_inside")
        most = open_.agg(F.max("_inside")).first()[0]
        if most is None:
            break
        kept = join_null_safe(rows, F.broadcast(open_) if small else open_, on).where(inside)
        if most <= few:
            values = kept.groupBy(*names).agg(F.array_sort(F.collect_list("_value")).alias("_v"), F.first("_rank").alias("_rank"))
            done.append(values.select(*names, F.get("_v", F.col("_rank").cast("int")).alias("_at")))
            break
        rows, on = checkpointed(kept.select(*names, "_value", "_rank")), keys

    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def quantiles(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None, limit: int = VALUES_PER_TASK,
    known: int | None = None, accuracy: int | None = None,
) -> DataFrame:
    """One row per group (one row without groups); each column holds its array of quantiles.

    Spark's ``percentile`` keeps all distinct values of a group in one buffer per column, so it is used
    only when a count shows that they are few enough. Beyond that, estimated splits bracket the two values around each
    quantile, and rows in and below the bracket are counted, until few enough are left in it: rows are neither sorted nor
    shuffled, and memory does not depend on how many values differ. ``accuracy`` asks for estimates
    instead, with a rank error of one in ``accuracy``.
    """
    by = by or []
    keys = [col(k) for k in by]
    slim = df.select(*keys, *[measure(df, c).alias(c) for c in columns])
    if accuracy:
        picks = [F.percentile_approx(col(c), [float(p) for p in probs], accuracy).alias(c) for c in columns]
        return slim.groupBy(*keys).agg(*picks)
    if small_groups(slim, by, max(1, limit // max(1, len(columns))), known):
        picks = [F.percentile(col(c), [float(p) for p in probs]).alias(c) for c in columns]
        return slim.groupBy(*keys).agg(*picks)

    long = slim.select(
        *keys, F.inline(F.array(*[F.struct(F.lit(c).alias("_column"), col(c).alias("_value")) for c in columns]))
    ).filter("_value IS NOT NULL")
    found = _narrowed(long, [*by, "_column"], probs)
    picks = [F.max(F.when(F.col("_target") == i, F.col("_at"))).alias(f"_{i}") for i in range(2 * len(probs))]
    found = found.groupBy(*[col(k) for k in by], "_column").agg(*picks)
    totals = long.groupBy(*[col(k) for k in by], "_column").agg(F.count("*").alias("_n"))
    found = join_null_safe(found, totals, [*by, "_column"])
    part = [(F.col("_n") - 1) * F.lit(float(p)) - F.floor((F.col("_n") - 1) * F.lit(float(p))) for p in probs]
    values = [F.col(f"_{2 * i}") + (F.col(f"_{2 * i + 1}") - F.col(f"_{2 * i}")) * part[i] for i in range(len(probs))]
    found = found.withColumn("_values", F.array(*values))
    arrays = found.select(*keys, "_column", "_values")
    last = [F.max(F.when(F.col("_column") == c, F.col("_values"))).alias(c) for c in columns]
    found = arrays.groupBy(*keys).agg(*last)
    # Groups without any value are rows too, as on the small path.
    return join_null_safe(slim.select(*keys).distinct(), found, by, how="left") if by else found


def fitted_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], limit: int = VALUES_PER_TASK, known: int | None = None
) -> dict:
    """Quantiles of the whole frame as ``{column: [values]}``, to be used as constants."""
    if not columns:
        return {}
    row = quantiles(df, columns, probs, limit=limit, known=known).first()
    return {c: list(row[c]) if row[c] is not None else None for c in columns}
