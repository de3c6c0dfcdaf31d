"""Column roles and quality flags from two aggregations over the table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalumen.functions import fixed
from datalumen.functions.columns import (
    any_of, col, hits, is_datetime, is_nested, is_numeric, is_placeholder, is_text, loose_number, missing,
    parsed_date, row_digest, share, tidy,
)


SCREEN_ERROR = 0.02


def _usable(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema if not is_nested(f)]


def _cells(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """The table as one row per cell: column number, text of text columns, missing flag, and a boolean-word flag.

    Grouping by the column number needs each test once, however many columns there are; the groups are
    merged in every task before the shuffle, so one row per task and column moves.
    """
    rows = []
    for i, f in enumerate(fields):
        c = col(f.name)
        if is_text(f):
            word = (F.length(c) <= 5) & F.lower(c).isin(fixed.BOOLEAN_WORDS)
        elif isinstance(f.dataType, T.BooleanType):
            word = c.isNotNull()
        elif isinstance(f.dataType, T.IntegralType):
            word = c.isin(0, 1)
        else:
            word = F.lit(False)
        rows.append(F.struct(
            F.lit(i).alias("position"), (c if is_text(f) else F.lit(None).cast("string")).alias("text"),
            missing(c, f).alias("gone"), word.alias("word")))
    return df.select(F.inline(F.array(*rows)))


def _named(stats: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """One row per column with its name, also for a table without rows; the list of names is a constant."""
    names = F.array(*[F.lit(f.name) for f in fields])
    spine = stats.sparkSession.range(len(fields)).select(
        F.col("id").cast("int").alias("position"), names[F.col("id").cast("int")].alias("column"))
    counts = [c for c in stats.columns if c != "position"]
    # Never more rows than columns.
    joined = spine.join(F.broadcast(stats), "position", "left")
    return joined.select("position", "column", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def missing_by_column(df: DataFrame) -> DataFrame:
    """Rows, nulls, placeholders and the effective missing share of every column, in one pass.

    A placeholder is counted on non-null values only, so that no missing cell counts twice.
    """
    fields = _usable(df)
    stats = _cells(df, fields).groupBy("position").agg(
        F.count("*").alias("total_count"), hits(F.col("gone")).alias("missing_count"),
        hits(is_placeholder(F.col("text"))).alias("null_like_count"))
    return _named(stats, fields).select(
        "column", "total_count", "missing_count", "null_like_count",
        share(F.col("missing_count") + F.col("null_like_count"), F.col("total_count")).alias("missing_pct"))


def distinct_by_column(df: DataFrame) -> DataFrame:
    """Distinct non-null values of every column and their share of the rows."""
    fields = _usable(df)
    values = [F.when(~missing(col(f.name), f), col(f.name)) for f in fields]
    wide = df.agg(F.count("*").alias("_rows"), *[F.count_distinct(v).alias(f"_d_{i}") for i, v in enumerate(values)])
    entries = [
        [F.lit(f.name), F.col("_rows"), F.col(f"_d_{i}"), share(F.col(f"_d_{i}"), F.col("_rows"))]
        for i, f in enumerate(fields)
    ]
    return tidy(wide, entries, ["column", "total_count", "unique_count", "unique_pct"])


def screened_distinct(df: DataFrame) -> DataFrame:
    """Estimated distinct counts, with an exact count for the columns whose estimate is near a deciding threshold.

    Exact counts of many columns shuffle every distinct value of every column; a role only changes near
    a threshold, so far from it an estimate decides the same.
    """
    fields = _usable(df)
    values = {f.name: F.when(~missing(col(f.name), f), col(f.name)) for f in fields}
    row = df.agg(F.count("*").alias("_rows"), *[
        F.approx_count_distinct(v, SCREEN_ERROR).alias(f"_d_{i}") for i, v in enumerate(values.values())]).first()
    rows = row["_rows"]
    counts = {f.name: row[f"_d_{i}"] for i, f in enumerate(fields)}
    marks = [1, 2, fixed.CATEGORY_LEVELS, fixed.CATEGORY_RATIO * rows, fixed.HIGH_CARDINALITY_PCT / 100 * rows, rows]
    close = [c for c, n in counts.items() if any(abs(n - m) <= max(2.0, 5 * SCREEN_ERROR * m) for m in marks)]
    if close:
        exact = df.agg(*[F.count_distinct(values[c]).alias(f"_e_{i}") for i, c in enumerate(close)]).first()
        counts |= {c: exact[f"_e_{i}"] for i, c in enumerate(close)}
    out = df.sparkSession.createDataFrame(
        [(c, rows, min(n, rows)) for c, n in counts.items()], "column string, total_count bigint, unique_count bigint")
    return out.withColumn("unique_pct", share(F.col("unique_count"), F.col("total_count")))


def _rate_by_text_column(df: DataFrame, tests: dict[str, Callable[[Column], Column]]) -> DataFrame:
    fields = [f for f in df.schema if is_text(f)]
    if not fields:
        schema = "column string, valid_count bigint, " + ", ".join(f"{t} double" for t in tests)
        return df.sparkSession.createDataFrame([], schema)
    stats = _cells(df, fields).groupBy("position").agg(
        F.count("text").alias("valid_count"), *[hits(test(F.col("text"))).alias(t) for t, test in tests.items()])
    return _named(stats, fields).select("column", "valid_count", *[
        F.coalesce(F.try_divide(F.col(t), F.col("valid_count")), F.lit(0.0)).alias(t) for t in tests])


def datetime_parse_rate(df: DataFrame) -> DataFrame:
    """Share of the values of each text column that read as a date."""
    return _rate_by_text_column(df, {"date_rate": lambda c: parsed_date(c).isNotNull()})


def numeric_string_rate(df: DataFrame) -> DataFrame:
    """Share of the values of each text column that read as a number once , $ and % are gone."""
    return _rate_by_text_column(df, {"number_rate": lambda c: loose_number(c).isNotNull()})


def pii_match(c: Column, name: str) -> Column:
    """Whether the pattern occurs; a cheap necessary condition spares most values the search."""
    hint = {"email": c.contains("@"), "ssn": c.contains("-"), "phone": F.length(c) >= 10, "credit_card": F.length(c) >= 13}
    return hint.get(name, F.lit(True)) & c.rlike(fixed.PII_PATTERNS[name])


def pii_rates(df: DataFrame) -> DataFrame:
    """Share of values with a match of each personal-data pattern, and the first pattern above the threshold."""
    tests = {f"{name}_rate": (lambda c, name=name: pii_match(c, name)) for name in fixed.PII_PATTERNS}
    rates = _rate_by_text_column(df, tests)
    return rates.withColumn("pii_type", _first_pii({name: F.col(f"{name}_rate") for name in fixed.PII_PATTERNS}))


def _first_pii(rates: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(rate > fixed.PII_RATE, F.lit(name)) for name, rate in rates.items()])


def row_counts(df: DataFrame, facts: dict[str, Column] | None = None) -> DataFrame:
    """One row: rows, exact repeats of an earlier row, and the sum of each of the given whole numbers per row, in one pass.

    Rows are counted by their digests, so no row is shuffled as a whole.
    """
    facts = facts or {}
    slim = df.select(*row_digest(df), *[value.alias(f"_fact_{i}") for i, value in enumerate(facts.values())])
    groups = slim.groupBy(*[c for c in slim.columns if c.startswith("_digest_")]).agg(
        F.count("*").alias("_n"), *[F.sum(f"_fact_{i}").alias(f"_fact_{i}") for i in range(len(facts))])

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).alias(name)

    return groups.agg(total(F.col("_n"), "num_rows"), total(F.col("_n") - 1, "duplicate_rows"),
                      *[total(F.col(f"_fact_{i}"), name) for i, name in enumerate(facts)])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, exact repeats of an earlier row, and their share."""
    return row_counts(df).withColumn("duplicate_pct", share(F.col("duplicate_rows"), F.col("num_rows")))


def inspect_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: type, role, missing and distinct counts, flags, personal data.

    Value tests run over all values instead of the first few, since a distributed table has no first rows.
    With ``approx`` the distinct counts are estimates wherever they do not decide a role.
    """
    fields = _usable(df)
    if not fields:
        raise ValueError("the table has no column of a plain type")
    text = F.col("text")
    tests = {
        "null": F.col("gone"), "bool": F.col("word"), "hold": is_placeholder(text), "date": parsed_date(text).isNotNull(),
        "num": loose_number(text).isNotNull(), **{f"pii_{name}": pii_match(text, name) for name in fixed.PII_PATTERNS},
    }
    stats = _cells(df, fields).groupBy("position").agg(
        F.count("*").alias("total_count"), *[hits(test).alias(f"_{t}") for t, test in tests.items()])
    kinds = ["text" if is_text(f) else "datetime" if is_datetime(f) else "numeric" if is_numeric(f) else "boolean"
             for f in fields]
    stats = _named(stats, fields).withColumns({
        "raw_type": F.array(*[F.lit(f.dataType.simpleString()) for f in fields])[F.col("position")],
        "_kind": F.array(*[F.lit(k) for k in kinds])[F.col("position")]})
    counts = (screened_distinct(df) if approx else distinct_by_column(df)).select("column", "unique_count")
    return _with_roles(stats.join(F.broadcast(counts), "column"))


def _with_roles(stats: DataFrame) -> DataFrame:
    valid = F.col("total_count") - F.col("_null")
    kind = F.col("_kind")
    distinct = F.col("unique_count")

    def above(count: str, rate: float) -> Column:
        return F.try_divide(F.col(count), valid) > rate

    inferred = (
        F.when(valid == 0, "empty")
        .when((kind == "boolean") | ((F.col("_bool") == valid) & (distinct <= 2)), "boolean")
        .when((kind == "datetime") | ((kind == "text") & above("_date", fixed.DATE_RATE)), "datetime")
        .when((kind == "numeric") | ((kind == "text") & above("_num", fixed.NUMBER_RATE)), "numerical")
        .when((F.try_divide(distinct, F.col("total_count")) < fixed.CATEGORY_RATIO)
              | (distinct <= fixed.CATEGORY_LEVELS), "categorical")
        .otherwise("text")
    )
    lower = F.lower("column")
    typed = stats.withColumn("inferred_type", inferred)
    kind = F.col("inferred_type")
    key = (distinct == F.col("total_count")) & (F.col("_null") == 0) & (F.col("total_count") > 0)
    ident = any_of([lower.endswith(s) for s in fixed.ID_SUFFIXES]) | (
        (distinct == F.col("total_count")) & (kind != "numerical"))
    role = F.when(ident, "id").when(kind == "empty", "text").otherwise(kind)
    target = ((role == "numerical") & lower.isin(fixed.TARGET_NAMES)) | (
        (role == "boolean") & any_of([lower.startswith(p) for p in fixed.FLAG_PREFIXES]))
    unique_pct = F.try_divide(distinct * F.lit(100.0), F.col("total_count"))
    constant = distinct <= 1
    pii = _first_pii({name: F.try_divide(F.col(f"_pii_{name}"), valid) for name in fixed.PII_PATTERNS})
    return typed.select(
        "position", "column", "raw_type", "inferred_type", role.alias("role"), "total_count",
        F.col("_null").alias("missing_count"), F.col("_hold").alias("null_like_count"),
        share(F.col("_null") + F.col("_hold"), F.col("total_count")).alias("missing_pct"),
        "unique_count", share(distinct, F.col("total_count")).alias("unique_pct"),
        constant.alias("is_constant"),
        F.coalesce(~constant & (unique_pct > fixed.HIGH_CARDINALITY_PCT) & kind.isin("categorical", "text"),
                   F.lit(False)).alias("is_high_cardinality"),
        key.alias("is_key_candidate"), target.alias("is_target_candidate"), pii.alias("pii_type"),
    )


def constant_columns(df: DataFrame) -> DataFrame:
    """``column, is_constant``: whether all values of a column that are there are equal (or none is there), by its extremes."""
    fields = _usable(df)
    ends = []
    for i, f in enumerate(fields):
        value = F.when(~missing(col(f.name), f), col(f.name))
        ends += [F.min(value).alias(f"_lo_{i}"), F.max(value).alias(f"_hi_{i}")]
    entries = [[F.lit(f.name), F.col(f"_lo_{i}").eqNullSafe(F.col(f"_hi_{i}"))] for i, f in enumerate(fields)]
    return tidy(df.agg(*ends), entries, ["column", "is_constant"])


def quality_facts(df: DataFrame) -> DataFrame:
    """One row per column: cells, gaps, placeholders, personal data and the constant flag, without any distinct count."""
    fields = _usable(df)
    if not fields:
        raise ValueError("the table has no column of a plain type")
    text = F.col("text")
    tests = {"missing_count": F.col("gone"), "null_like_count": is_placeholder(text),
             **{f"_pii_{name}": pii_match(text, name) for name in fixed.PII_PATTERNS}}
    stats = _named(_cells(df, fields).groupBy("position").agg(
        F.count("*").alias("total_count"), *[hits(test).alias(t) for t, test in tests.items()]), fields)
    valid = F.col("total_count") - F.col("missing_count")
    pii = _first_pii({name: F.try_divide(F.col(f"_pii_{name}"), valid) for name in fixed.PII_PATTERNS})
    # One row per column.
    return stats.join(F.broadcast(constant_columns(df)), "column").select(
        "column", "total_count", "missing_count", "null_like_count", pii.alias("pii_type"), "is_constant")


def pk_candidates(df: DataFrame) -> DataFrame:
    """Columns whose exact distinct count equals the row count with no null.

    One pass estimates the distinct counts; only columns without gaps whose estimate is within five standard errors of
    the row count are counted exactly, so the values of all other columns are never shuffled.
    """
    fields = _usable(df)
    values = {f.name: F.when(~missing(col(f.name), f), col(f.name)) for f in fields}
    row = df.agg(F.count("*").alias("_rows"), *[x for i, v in enumerate(values.values()) for x in (
        F.count(v).alias(f"_n_{i}"), F.approx_count_distinct(v, SCREEN_ERROR).alias(f"_d_{i}"))]).first()
    rows = row["_rows"]
    close = [c for i, c in enumerate(values) if rows and row[f"_n_{i}"] == rows
             and rows - row[f"_d_{i}"] <= max(2.0, 5 * SCREEN_ERROR * rows)]
    found = df.sparkSession.createDataFrame([], "column string, total_count bigint")
    for c in close:
        exact = df.agg(F.count_distinct(values[c]).alias("_d"))
        found = found.union(exact.filter(F.col("_d") == rows).select(F.lit(c), F.lit(rows).cast("bigint")))
    return found


@dataclass(frozen=True)
class TableMeta:
    """Roles of the columns of a table, in schema order."""

    num_rows: int
    columns: tuple[str, ...]
    id_columns: tuple[str, ...] = ()
    datetime_columns: tuple[str, ...] = ()
    numerical_columns: tuple[str, ...] = ()
    categorical_columns: tuple[str, ...] = ()
    text_columns: tuple[str, ...] = ()
    boolean_columns: tuple[str, ...] = ()
    constant_columns: tuple[str, ...] = ()
    high_cardinality_columns: tuple[str, ...] = ()
    key_candidates: tuple[str, ...] = ()
    target_candidates: tuple[str, ...] = ()
    unique_counts: dict = field(default_factory=dict)
    pii: dict = field(default_factory=dict)

    def with_numeric(self, names: list[str]) -> "TableMeta":
        """The roles after ``names`` became numbers; new ones go to the end."""
        moved = [n for n in names if n not in self.numerical_columns]
        return replace(
            self,
            numerical_columns=(*self.numerical_columns, *moved),
            categorical_columns=tuple(c for c in self.categorical_columns if c not in names),
            text_columns=tuple(c for c in self.text_columns if c not in names),
        )


def table_meta(df: DataFrame, approx: bool = False) -> TableMeta:
    """Collect the inspection (one row per column) into a ``TableMeta``."""
    return meta_from_rows(inspect_columns(df, approx).collect(), df.columns)


def meta_from_rows(rows: list, columns: list[str]) -> TableMeta:
    rows = sorted(rows, key=lambda r: r["position"])

    def named(test) -> tuple[str, ...]:
        return tuple(r["column"] for r in rows if test(r))

    roles = {role: named(lambda r, role=role: r["role"] == role)
             for role in ("id", "datetime", "numerical", "categorical", "text", "boolean")}
    return TableMeta(
        num_rows=rows[0]["total_count"] if rows else 0,
        columns=tuple(columns),
        **{f"{role}_columns": names for role, names in roles.items()},
        constant_columns=named(lambda r: r["is_constant"]),
        high_cardinality_columns=named(lambda r: r["is_high_cardinality"]),
        key_candidates=named(lambda r: r["is_key_candidate"]),
        target_candidates=named(lambda r: r["is_target_candidate"]),
        unique_counts={r["column"]: r["unique_count"] for r in rows},
        pii={r["column"]: r["pii_type"] for r in rows if r["pii_type"]},
    )
