"""Streaming forms over the events, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.operators.cleaning import fit_fences
from datalumen.plans.registry import Tables, query
from datalumen.streaming import streams


def event_stream(t: Tables) -> DataFrame:
    """The events as a stream; a table that is one single file is picked out of its folder by name."""
    reader = t.spark.readStream.schema(t.events.schema)
    if t.events.inputFiles()[0].endswith("/events.parquet"):
        return reader.option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return reader.parquet(f"{t.folder}/events.parquet")


@query("stream_daily", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS volume, round(sum(value), 2) AS total FROM events
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1""")
def stream_daily(t: Tables) -> DataFrame:
    days = streams.run_to_files(streams.daily_totals(event_stream(t), "ts", "value"), "daily")
    return days.withColumn("day", F.col("day").cast("string"))


@query("stream_dedup", "SELECT DISTINCT event_id, user_id, event_type, value FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    twice = event_stream(t).unionByName(event_stream(t))
    once = streams.run_to_files(streams.dedup(twice, ["event_id"], "ts", "40 days"), "dedup")
    return once.select("event_id", "user_id", "event_type", "value")


@query("stream_flag_outliers", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, value, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS value_outlier FROM events, q""")
def stream_flag_outliers(t: Tables) -> DataFrame:
    fences = fit_fences(t.events, ["value"])
    flagged = streams.flag_outliers(event_stream(t).select("event_id", "value"), fences)
    return streams.run_to_files(flagged, "flags")
