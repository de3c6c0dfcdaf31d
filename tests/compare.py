"""Run registered queries beside their SQL and compare rows by column name and value."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from datalumen.plans.registry import NAMES  # noqa: E402


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v) + 0.0:.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def oracle(folder):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder, name):
    df = entry.queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return (f"rows only ({len(got)})" if got else "EMPTY"), None
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_columns):
        return "COLUMNS", (sorted(df.columns), sorted(want_columns))
    a, b = rows_of(df.columns, got), rows_of(want_columns, want)
    if a == b:
        return f"ok ({len(a)})", None
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return "DIFFERS", (sorted(df.columns), len(a), len(b), only_a, only_b)


if __name__ == "__main__":
    from datalumen.session import get_session

    folder = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = get_session("compare", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = oracle(folder), []
    for name in names:
        start = time.time()
        try:
            verdict, detail = compare(spark, con, folder, name)
        except Exception as problem:  # noqa: BLE001
            verdict, detail = "ERROR", "".join(traceback.format_exception_only(problem))[:1500]
        print(f"{name:28s} {time.time() - start:6.2f}s {verdict}", flush=True)
        if detail:
            print("   ", detail, flush=True)
        if verdict.split()[0] not in ("ok", "rows"):
            bad.append(name)
    print(len(names), "queries,", len(bad), "bad:", " ".join(bad))
