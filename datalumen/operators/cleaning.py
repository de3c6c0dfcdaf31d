"""Cleaning as single steps and as a fitted plan that can be applied to other data or to a stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalumen.functions import fixed
from datalumen.functions.columns import (
    adjusted_skew, col, formatted_number, hits, is_placeholder, is_text, measure, missing, parsed_date, row_keys, strip,
    text_columns,
)
from datalumen.operators.inspection import TableMeta
from datalumen.operators.quantiles import fitted_quantiles
from datalumen.session import checkpointed


# --- single steps -------------------------------------------------------------------------------------

def clean_numeric_strings(df: DataFrame, columns: list[str] | None = None, lenient: bool = False) -> DataFrame:
    """Turn text columns into numbers where enough values read as one; whole numbers become bigint."""
    kinds = fit_numeric_strings(df, columns, lenient)
    return df.withColumns({c: _numeric_cast(col(c), kind, lenient) for c, (kind, _) in kinds.items()})


def fit_numeric_strings(df: DataFrame, columns: list[str] | None = None, lenient: bool = False) -> dict:
    """``{column: (type, converted values)}`` for the text columns that hold numbers."""
    names = columns if columns is not None else text_columns(df)
    names = [n for n in names if is_text(df.schema[n])]
    if not names:
        return {}
    return _numeric_kinds(names, _text_stats(df, names, True, lenient))


def _text_stats(df: DataFrame, names: list[str], strip_first: bool, lenient: bool) -> dict:
    """Counts over the cells of the text columns, ``{column: row}``: numbers, white space, placeholders.

    Every cell is one row with its column number, so each test is stated once and merged in every task.
    """
    cells = [F.struct(F.lit(i).alias("i"), col(n).alias("text")) for i, n in enumerate(names)]
    text, value = F.col("text"), F.col("value")
    bare = strip(text)
    rows = df.select(F.inline(F.array(*cells))).withColumn("value", formatted_number(text, lenient))
    stats = rows.groupBy("i").agg(
        F.count(text).alias("valid"), F.count(value).alias("numbers"),
        hits((value != F.floor(value)) | (F.abs(value) > 2.0**53)).alias("fractions"),
        hits(text != bare).alias("padded"), hits(is_placeholder(bare if strip_first else text)).alias("placeholders"))
    return {names[r["i"]]: r for r in stats.collect()}


def _numeric_kinds(names: list[str], stats: dict) -> dict:
    return {
        n: ("double" if stats[n]["fractions"] else "bigint", stats[n]["numbers"])
        for n in names
        if n in stats and stats[n]["numbers"] and stats[n]["numbers"] / stats[n]["valid"] >= fixed.CONVERT_RATE
    }


def _numeric_cast(c: Column, kind: str, lenient: bool) -> Column:
    value = formatted_number(c, lenient)
    return value.cast(kind) if kind == "bigint" else value


def clean_trim(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Strip white space of text columns."""
    return df.withColumns({c: strip(col(c)) for c in (columns or text_columns(df))})


def clean_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Placeholder texts become null."""
    return df.withColumns({c: F.when(~is_placeholder(col(c)), col(c)) for c in (columns or text_columns(df))})


def clean_dedup(df: DataFrame) -> DataFrame:
    """One copy of every row. Copies are merged before the shuffle, so a big group of copies costs one row per task."""
    keys = row_keys(df)
    if "map<" not in df.schema.simpleString():
        return df.dropDuplicates()
    names = [f"_key_{i}" for i in range(len(keys))]
    return df.withColumns(dict(zip(names, keys))).dropDuplicates(names).drop(*names)


def label_columns(df: DataFrame, names: list[str] | None = None) -> dict[str, dict[str, str]]:
    """The default label mapping for the columns whose name asks for it."""
    names = names if names is not None else text_columns(df)
    return {n: fixed.LABEL_MAP for n in names if any(word in n.lower() for word in fixed.LABEL_COLUMNS)}


#: Entries of a label mapping that are written into the plan; a larger mapping is joined.
IN_PLAN = 200


def _relabel(c: Column, mapping: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.upper(strip(c))), c)


def clean_labels(df: DataFrame, mappings: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Replace label spellings by their canonical form; keys of the mapping are upper case."""
    mappings = label_columns(df) if mappings is None else mappings
    df = df.withColumns({c: _relabel(col(c), m) for c, m in mappings.items() if len(m) <= IN_PLAN})
    for c, m in mappings.items():
        if len(m) > IN_PLAN:
            df = _relabel_joined(df, c, m)
    return df


def _relabel_joined(df: DataFrame, c: str, mapping: dict[str, str]) -> DataFrame:
    """The same by a join with the mapping, whose entries then stay out of the plan; Spark picks the join by its size."""
    spelling, label = f"_spelling_of_{c}", f"_label_of_{c}"
    entries = df.sparkSession.createDataFrame(list(mapping.items()), T.StructType([
        T.StructField(spelling, T.StringType()), T.StructField(label, T.StringType())]))
    met = df.join(entries, F.upper(strip(col(c))) == col(spelling), "left")
    return met.withColumn(c, F.coalesce(col(label), col(c))).drop(spelling, label)


def clean_cast_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to timestamp where at least one value parses; unreadable values become null."""
    names = [c for c in columns if is_text(df.schema[c])]
    if not names:
        return df
    found = df.agg(*[F.count(parsed_date(col(c))).alias(c) for c in names]).first()
    return df.withColumns({c: parsed_date(col(c)) for c in names if found[c]})


def fit_numeric_fill(df: DataFrame, columns: list[str], strategy: str = "median") -> dict:
    """``{column: (fill, chosen, missing, skew)}`` for the columns with missing values.

    ``auto`` takes the median of a skewed column and the mean otherwise.
    """
    _check_strategy(strategy)
    return _numeric_fills(df, columns, strategy, df.agg(*_number_facts(df, columns)).first()) if columns else {}


def _check_strategy(strategy: str) -> None:
    if strategy not in ("median", "mean", "auto"):
        raise ValueError("strategy is median, mean or auto")


def _number_facts(df: DataFrame, columns: list[str]) -> list[Column]:
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        value = measure(df, c)
        aggs += [hits(value.isNull()).alias(f"gap{i}"), F.avg(value).alias(f"mean{i}"), adjusted_skew(value).alias(f"skew{i}")]
    return aggs


def _numeric_fills(df: DataFrame, columns: list[str], strategy: str, row: Row) -> dict:
    gaps = {c: i for i, c in enumerate(columns) if row[f"gap{i}"] and row[f"mean{i}"] is not None}
    chosen = {
        c: "median" if strategy == "median" or (strategy == "auto" and abs(row[f"skew{i}"] or 0) > 0.5) else "mean"
        for c, i in gaps.items()
    }
    medians = fitted_quantiles(df, [c for c in gaps if chosen[c] == "median"], [0.5], known=row["rows"])
    return {
        c: (medians[c][0] if chosen[c] == "median" else row[f"mean{i}"], chosen[c], row[f"gap{i}"], row[f"skew{i}"])
        for c, i in gaps.items()
    }


def fit_category_fill(df: DataFrame, columns: list[str], strategy: str = "mode") -> dict:
    """``{column: (fill, missing)}``; the mode takes the smallest value among ties, anything else is "Unknown".

    The mode comes from value counts per column, so no task holds all distinct values.
    """
    return _category_fills(df, columns, strategy, df.agg(*_label_facts(columns)).first()) if columns else {}


def _label_facts(columns: list[str]) -> list[Column]:
    return [hits(col(c).isNull()).alias(f"blank{i}") for i, c in enumerate(columns)]


def _category_fills(df: DataFrame, columns: list[str], strategy: str, row: Row) -> dict:
    gaps = {c: row[f"blank{i}"] for i, c in enumerate(columns) if row[f"blank{i}"]}
    modes = {}
    if gaps and strategy == "mode":
        best = value_counts(df, list(gaps)).filter("value IS NOT NULL").groupBy("column").agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
        modes = {r["column"]: r["value"] for r in best.collect()}
    return {c: (modes.get(c, "Unknown"), n) for c, n in gaps.items()}


def value_counts(df: DataFrame, columns: list[str], null: str | None = None) -> DataFrame:
    """``(column, value, n)`` for several columns from one scan; null is a value of its own, by the name given."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.coalesce(col(c).cast("string"), F.lit(null)).alias("value")) for c in columns
    ]
    return df.select(F.inline(F.array(*cells))).groupBy("column", "value").agg(F.count("*").alias("n"))


def impute_numeric(df: DataFrame, columns: list[str], strategy: str = "median") -> DataFrame:
    """Fill missing numbers by a statistic of the column."""
    return _fill(df, {c: v[0] for c, v in fit_numeric_fill(df, columns, strategy).items()})


def impute_category(df: DataFrame, columns: list[str], strategy: str = "mode") -> DataFrame:
    """Fill missing labels by the mode or by "Unknown"."""
    return _fill(df, {c: v[0] for c, v in fit_category_fill(df, columns, strategy).items()})


def _fill(df: DataFrame, fills: dict) -> DataFrame:
    new = {}
    for c, value in fills.items():
        f = df.schema[c]
        if is_text(f) and isinstance(value, str):
            new[c] = F.coalesce(col(c), F.lit(value))
        elif is_text(f):  # numbers held as text that were not converted: the filled column is numeric
            new[c] = F.coalesce(measure(df, c), F.lit(float(value)))
        else:
            whole = isinstance(f.dataType, T.IntegralType) and float(value).is_integer()
            kept = F.when(~missing(col(c), f), col(c))
            new[c] = F.coalesce(kept, F.lit(int(value)).cast(f.dataType)) if whole else F.coalesce(
                kept.cast("double"), F.lit(float(value)))
    return df.withColumns(new)


@dataclass(frozen=True)
class Fence:
    low: float
    high: float
    method: str
    valid: int
    outliers: int


def fit_fences(df: DataFrame, columns: list[str], min_rows: int = 10) -> dict[str, Fence]:
    """Outlier fences: quartiles widened by 1.5 times their distance, or mean and 3.5 deviations if that is 0."""
    if not columns:
        return {}
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        value = measure(df, c)
        aggs += [F.count(value).alias(f"n{i}"), F.avg(value).alias(f"m{i}"), F.stddev_samp(value).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    quarts = fitted_quantiles(df, columns, [0.25, 0.75], known=row["rows"])
    bounds = {}
    for i, c in enumerate(columns):
        if row[f"n{i}"] < min_rows:
            continue
        low, high = quarts[c]
        if high > low:
            bounds[c] = (low - 1.5 * (high - low), high + 1.5 * (high - low), "iqr", row[f"n{i}"])
        elif row[f"s{i}"]:
            reach = 3.5 * row[f"s{i}"]
            bounds[c] = (row[f"m{i}"] - reach, row[f"m{i}"] + reach, "z-score", row[f"n{i}"])
    if not bounds:
        return {}
    out = df.agg(*[hits(outside(measure(df, c), b[0], b[1])).alias(c) for c, b in bounds.items()]).first()
    return {c: Fence(*b, outliers=out[c]) for c, b in bounds.items()}


def outside(value: Column, low: float, high: float) -> Column:
    return (value < F.lit(low)) | (value > F.lit(high))


def outlier_clip(df: DataFrame, columns: list[str], fences: dict[str, Fence] | None = None) -> DataFrame:
    """Move values beyond the fences onto them."""
    fences = fit_fences(df, columns) if fences is None else fences
    return df.withColumns({c: _clipped(df, c, f) for c, f in fences.items() if f.outliers})


def _clipped(df: DataFrame, c: str, fence: Fence) -> Column:
    value = measure(df, c)
    bounded = F.least(F.greatest(value, F.lit(fence.low)), F.lit(fence.high))
    return F.when(value.isNotNull(), bounded)


def outlier_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with fences: method, bounds, outliers and their share."""
    rows = [(c, f.method, f.valid, f.outliers, f.low, f.high) for c, f in fit_fences(df, columns).items()]
    found = df.sparkSession.createDataFrame(
        rows, "column string, method string, valid_count bigint, outlier_count bigint, low double, high double")
    return found.select(
        "column", "method", "valid_count", "outlier_count",
        F.round(F.col("outlier_count") * 100.0 / F.col("valid_count"), 1).alias("outlier_pct"),
        F.round("low", 2).alias("lower_fence"), F.round("high", 2).alias("upper_fence"))


# --- the fitted plan ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class CleaningOptions:
    numeric_strings: bool = True
    trim: bool = True
    nulls: bool = True
    dedup: bool = True
    labels: bool = True
    dates: bool = True
    numeric_fill: str = "median"
    category_fill: str = "mode"
    outliers: str = "clip"
    lenient: bool = False
    durable: bool = True


@dataclass(frozen=True)
class CleaningPlan:
    """Everything the fit decided; applying it needs no further statistics."""

    numbers: dict[str, str] = field(default_factory=dict)
    trim: tuple[str, ...] = ()
    nulls: tuple[str, ...] = ()
    dedup: bool = False
    labels: dict[str, dict[str, str]] = field(default_factory=dict)
    dates: tuple[str, ...] = ()
    fills: dict = field(default_factory=dict)
    fences: dict[str, Fence] = field(default_factory=dict)
    lenient: bool = False

    def rewrite_cells(self, df: DataFrame) -> DataFrame:
        """The steps before duplicates are removed."""
        df = df.withColumns({c: _numeric_cast(col(c), kind, self.lenient) for c, kind in self.numbers.items()})
        df = clean_trim(df, list(self.trim)) if self.trim else df
        return clean_nulls(df, list(self.nulls)) if self.nulls else df

    def finish_cells(self, df: DataFrame) -> DataFrame:
        """The steps after duplicates are removed; row by row, so they also run on a stream."""
        df = clean_labels(df, self.labels)
        df = df.withColumns({c: parsed_date(col(c)) for c in self.dates})
        df = _fill(df, self.fills)
        return df.withColumns({c: _clipped(df, c, f) for c, f in self.fences.items()})

    def apply(self, df: DataFrame) -> DataFrame:
        df = self.rewrite_cells(df)
        df = clean_dedup(df) if self.dedup else df
        return self.finish_cells(df)


@dataclass(frozen=True)
class CleaningResult:
    cleaned: DataFrame
    log: DataFrame
    plan: CleaningPlan
    meta: TableMeta
    kept: DataFrame

    def release(self) -> None:
        """Give back the memory and disk of the kept table."""
        self.kept.unpersist()


LOG_SCHEMA = "step int, issue string, action string, column string, records_affected bigint, details string"


def clean(df: DataFrame, meta: TableMeta, options: CleaningOptions = CleaningOptions()) -> CleaningResult:
    """Fit all steps in their fixed order and return the cleaned table, the log, the plan and the new roles.

    Text is fitted in one pass over the raw table, fills on the table without duplicates, and fences on
    the filled table. Ids and dates are never turned into numbers unless ``lenient`` asks for it.
    The table without duplicates is kept for the later passes: in the shared folder, or without ``durable`` in
    the executors. One pass over it counts everything that labels, dates and fills need.
    """
    log: list[tuple] = []

    def note(issue: str, action: str, column: str, affected: int, details: str = "") -> None:
        if affected:
            log.append((len(log) + 1, issue, action, column, int(affected), details))

    guarded = set() if options.lenient else {*meta.id_columns, *meta.datetime_columns}
    texts = text_columns(df)
    maybe = [c for c in texts if c not in guarded] if options.numeric_strings else []
    stats = _text_stats(df, texts, options.trim, options.lenient) if texts else {}
    numbers = _numeric_kinds(maybe, stats)
    for c, (kind, n) in numbers.items():
        note("formatted numbers", f"converted to {kind}", c, n)
        note("unreadable numbers", "set to null", c, stats[c]["valid"] - n)
    texts = [c for c in texts if c in stats and c not in numbers]
    for c in texts if options.trim else []:
        note("white space", "trimmed", c, stats[c]["padded"])
    for c in texts if options.nulls else []:
        note("placeholders", "set to null", c, stats[c]["placeholders"])
    plan = CleaningPlan(
        numbers={c: kind for c, (kind, _) in numbers.items()}, trim=tuple(texts) if options.trim else (),
        nulls=tuple(texts) if options.nulls else (), dedup=options.dedup, lenient=options.lenient)
    roles = meta.with_numeric(list(numbers))

    body = plan.rewrite_cells(df)
    if options.dedup:
        body = clean_dedup(body)
        body = checkpointed(body) if options.durable else body.persist(StorageLevel.MEMORY_AND_DISK)
    labels = label_columns(body, [c for c in roles.categorical_columns if c in texts]) if options.labels else {}
    dates = [c for c in roles.datetime_columns if is_text(body.schema[c])] if options.dates else []
    numeric = list(roles.numerical_columns) if options.numeric_fill != "none" else []
    named = [c for c in roles.categorical_columns if is_text(body.schema[c])] if options.category_fill != "none" else []
    if numeric:
        _check_strategy(options.numeric_fill)
    found = body.agg(
        *_number_facts(body, numeric), *_label_facts(named), *[hits(_relabel(col(c), m) != col(c)).alias(f"l_{c}") for c, m in labels.items()],
        *[F.count(parsed_date(col(c))).alias(f"d_{c}") for c in dates]).first()
    note("duplicate rows", "removed", "*", meta.num_rows - found["rows"])
    labels = {c: m for c, m in labels.items() if found[f"l_{c}"]}
    dates = [c for c in dates if found[f"d_{c}"]]
    for c in labels:
        note("label spellings", "unified", c, found[f"l_{c}"])
    for c in dates:
        note("dates as text", "converted to timestamp", c, found[f"d_{c}"])
    plan = CleaningPlan(**{**vars(plan), "labels": labels, "dates": tuple(dates)})

    shaped = plan.finish_cells(body)
    fills = {}
    for c, (value, chosen, gaps, skew) in _numeric_fills(shaped, numeric, options.numeric_fill, found).items():
        fills[c] = value
        note("missing numbers", f"filled with {chosen}", c, gaps, f"value={round(value, 2)}")
    for c, (value, gaps) in _category_fills(shaped, named, options.category_fill, found).items():
        fills[c] = value
        note("missing labels", "filled with " + ("mode" if options.category_fill == "mode" else "Unknown"),
             c, gaps, f"value={value}")
    plan = CleaningPlan(**{**vars(plan), "fills": fills})

    if options.outliers != "none":
        filled = plan.finish_cells(body)
        fences = {c: f for c, f in fit_fences(filled, list(roles.numerical_columns)).items() if f.outliers}
        for c, f in fences.items():
            action = "clipped" if options.outliers == "clip" else "reported"
            note("outliers", f"{action} by {f.method}", c, f.outliers, f"{round(f.low, 2)} to {round(f.high, 2)}")
        if options.outliers == "clip":
            plan = CleaningPlan(**{**vars(plan), "fences": fences})
    return CleaningResult(
        plan.finish_cells(body), df.sparkSession.createDataFrame(log, LOG_SCHEMA), plan, roles, body)
