"""Read-only SQL over registered tables; the SQL itself is Spark's."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# How a query may start, the commands that may follow a WITH or FROM clause, and functions that run other code.
STARTS = ["SELECT", "WITH", "VALUES", "FROM"]
COMMAND = r"\b(INSERT) +(?:INTO|OVERWRITE)\b|\b(DELETE) +FROM\b|\b(UPDATE) +\S+ +SET\b|\b(MERGE) +INTO\b"
CALLS = ["reflect", "java_method", "try_reflect"]

# A relation of two parts, one of which is quoted and no plain name (a file behind any format or class name), and a quoted path.
RELATION = r"\b(?:FROM|JOIN|TABLE) *\(* *(?:[\w.]+|`[^`]*`) *\. *`(?!\w+`)|\b(?:FROM|JOIN|TABLE) *\(* *`(?!\w+`)[^`]*` *\."
PATH = r"\. *`[^`]*[/:\\][^`]*`"

TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`|--[^\n]*|/\*|\w+|\s+|.", re.S)


def _tokens(query: str) -> list[str]:
    """The words and signs of a query: literals as two quotes, comments (nested ones too) left out, white space as one blank."""
    out, at = [], 0
    while at < len(query):
        token = TOKEN.match(query, at)[0]
        at += len(token)
        if token == "/*":
            depth = 1
            while depth and at < len(query):
                two = query[at:at + 2]
                depth += {"/*": 1, "*/": -1}.get(two, 0)
                at += 2 if two in ("/*", "*/") else 1
            out.append(" ")
        elif token[0] in "'\"" and len(token) > 1:
            out.append("''")
        else:
            out.append(" " if token.startswith("--") or token.isspace() else token)
    return out


class ReadOnlyError(ValueError):
    """The query is not a single read-only statement."""


def check_read_only(query: str) -> None:
    """Refuse anything but one SELECT-like statement. Text in literals and comments does not count."""
    tokens = _tokens(query)
    # Quoted names are no statement words, but they can call functions and name file formats.
    bare = "".join("_" if t[0] == "`" else t for t in tokens).strip().rstrip("; ")
    named = "".join(t[1:-1] if t[0] == "`" and t[1:-1].isidentifier() else t for t in tokens)
    first = re.match(r"[( ]*(\w+)", bare)
    if not first or first.group(1).upper() not in STARTS:
        raise ReadOnlyError("only SELECT, WITH, VALUES and FROM queries are allowed")
    if ";" in bare:
        raise ReadOnlyError("one statement at a time")
    word = re.search(COMMAND, bare, re.I)
    if word:
        raise ReadOnlyError(f"{word.group(0).split()[0].upper()} is not allowed in a read-only query")
    call = re.search(r"\b(" + "|".join(CALLS) + r") *\(", named, re.I)
    if call:
        raise ReadOnlyError(f"{call.group(1)} is not allowed")
    if re.search(r"\b(parquet|csv|json|orc|text|avro|binaryfile|delta|jdbc) *\. *`", named, re.I):
        raise ReadOnlyError("files are read through the source functions")
    whole = "".join(tokens)
    if re.search(RELATION, whole, re.I) or re.search(PATH, whole):
        raise ReadOnlyError("only registered tables can be read")


@dataclass(frozen=True)
class Outcome:
    success: bool
    rows: DataFrame | None
    columns: tuple[str, ...] = ()
    error: str | None = None
    n_rows: int | None = None


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run one read-only query; ``tables`` are registered under their names first."""
    check_read_only(sql)
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql.strip().rstrip(";"))


def try_query(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None) -> Outcome:
    """As ``query``, but run for its row count; refusals and errors, at run time too, are reported instead of raised."""
    try:
        rows = query(spark, sql, tables)
        seen = Observation()
        # A count alone would leave columns out, and their errors.
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        return Outcome(True, rows, tuple(rows.columns), n_rows=seen.get["n"])
    except (ReadOnlyError, PySparkException) as problem:
        return Outcome(False, None, error=str(problem).splitlines()[0])
