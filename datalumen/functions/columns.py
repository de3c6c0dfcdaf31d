"""Column expressions shared by the operators. Everything here stays inside Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalumen.functions import fixed

PLAIN_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
FORMATTED_NUMBER = (r"^\(?[+-]?[$£€¥₹]?\s*[+-]?\s*(\d{1,3}( \d{3})+(\.\d*)?|\d[\d,]*(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*%?\)?$")
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}:\d{1,2})?$"
SLASH_DATE = r"^\d{1,4}/\d{1,2}/\d{1,4}$"
SPACE = " \t\n\x0b\f\r"


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.VarcharType, T.CharType))


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_datetime(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_nested(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f)]


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` alone removes spaces only)."""
    return F.trim(c, F.lit(SPACE))


def is_placeholder(c: Column) -> Column:
    return F.lower(strip(c)).isin(fixed.PLACEHOLDERS)


def row_keys(df: DataFrame) -> list[Column]:
    """Columns that tell rows apart; maps, which cannot be grouped, count as their sorted entries."""

    def comparable(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.MapType):
            return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(
                comparable(e["key"], kind.keyType).alias("k"), comparable(e["value"], kind.valueType).alias("v"))))
        if isinstance(kind, T.ArrayType) and _holds_map(kind):
            return F.transform(c, lambda x: comparable(x, kind.elementType))
        if isinstance(kind, T.StructType) and _holds_map(kind):
            return F.when(c.isNotNull(), F.struct(*[comparable(c[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind)]))
        return c

    return [comparable(col(f.name), f.dataType) for f in df.schema]


def row_digest(df: DataFrame) -> list[Column]:
    """Three 64-bit hashes that stand for a whole row where rows are only counted.

    Nulls count by their place. Different rows share all three with a chance below one in 10^30 even among 10^13 rows,
    but texts made to collide on purpose would count as equal.
    """
    parts = [part for key in row_keys(df) for part in (key.isNull(), key)]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"_digest_{seed}") for seed in range(3)]


def _holds_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString()


def missing(c: Column, field: T.StructField) -> Column:
    """Null, or NaN in a floating column: both mean that no value is there."""
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _number(trimmed: Column) -> Column:
    return F.when(trimmed.rlike(PLAIN_NUMBER), trimmed.try_cast("double"))


def plain_number(c: Column) -> Column:
    """Text to double; anything that is not a number becomes null (ANSI mode would raise)."""
    return _number(strip(c))


def loose_number(c: Column) -> Column:
    """Text to double after dropping thousands commas, dollar and percent signs."""
    return plain_number(F.translate(c, ",$%", ""))


def formatted_number(c: Column, lenient: bool = False) -> Column:
    """Currency, percent, grouped and bracketed numbers to double.

    The strict form converts only values that are a number as a whole, so codes such as ``TX1001``
    and dates are left alone; the lenient form drops every other character first.
    """
    bare = F.translate(c, "$£€¥₹,%" + SPACE, "")
    signed = F.when(bare.contains("("), F.regexp_replace(bare, r"\((\d+\.?\d*)\)", "-$1")).otherwise(bare)
    if lenient:
        return _number(F.regexp_replace(signed, r"[^\d.\-+]", ""))
    return F.when(strip(c).rlike(FORMATTED_NUMBER), _number(signed))


def parsed_date(c: Column) -> Column:
    """Text to timestamp by the accepted layouts, null where none fits.

    ISO layouts go through the plain cast, which is many times faster than a format.
    """
    trimmed = strip(c)
    slashed = [F.try_to_timestamp(trimmed, F.lit(layout)) for layout in fixed.SLASH_FORMATS]
    return F.when(trimmed.rlike(ISO_DATE), trimmed.try_cast("timestamp")).when(
        trimmed.rlike(SLASH_DATE), F.coalesce(*slashed))


def clean_double(c: Column, field: T.StructField) -> Column:
    """Any measure as double with NaN folded into null and bad text into null."""
    if is_text(field):
        return plain_number(c)
    value = c.cast("double")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    return value


def measure(df: DataFrame, name: str) -> Column:
    return clean_double(col(name), df.schema[name])


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, 0 when there is nothing to divide by."""
    return F.coalesce(F.round(F.try_divide(part * F.lit(100.0), whole), digits), F.lit(0.0))


def adjusted_skew(c: Column) -> Column:
    """Bias-adjusted skewness; null below three values, 0 for a constant column."""
    n = F.count(c).cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    skew = F.skewness(c)
    return F.when(F.count(c) > 2, F.coalesce(F.when(~F.isnan(skew), skew), F.lit(0.0)) * factor)


def hits(condition: Column) -> Column:
    """Number of rows for which the condition holds, 0 on an empty input."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def tidy(wide: DataFrame, entries: list[list[Column]], names: list[str]) -> DataFrame:
    """One wide row to one row per entry."""
    rows = [F.struct(*[c.alias(n) for c, n in zip(entry, names)]) for entry in entries]
    return wide.select(F.inline(F.array(*rows)))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the right key columns are dropped."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_r_{key}")
    on = reduce(lambda a, b: a & b, [col(k).eqNullSafe(col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])
