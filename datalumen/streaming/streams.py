"""Day totals, duplicate removal and fitted cleaning on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from datalumen.functions.columns import col
from datalumen.operators.cleaning import CleaningPlan, Fence, outside
from datalumen.session import scratch_path


def event_time(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks need a time with zone; the session runs in UTC."""
    return stream.withColumn(time, col(time).cast("timestamp"))


def daily_totals(stream: DataFrame, time: str, value: str, late: str = "1 day") -> DataFrame:
    """Rows and sum per day; a day is given out once the watermark has passed its end."""
    windows = event_time(stream, time).withWatermark(time, late).groupBy(F.window(col(time), "1 day"))
    totals = windows.agg(F.count("*").alias("volume"), F.sum(col(value)).alias("total"))
    return totals.select(F.col("window.start").cast("date").alias("day"), "volume", F.round("total", 2).alias("total"))


def dedup(stream: DataFrame, key: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first copy of each key; state is dropped once the watermark has passed."""
    return event_time(stream, time).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def flag_outliers(stream: DataFrame, fences: dict[str, Fence]) -> DataFrame:
    """Mark values beyond fences fitted before; stateless."""
    return stream.withColumns(
        {f"{c}_outlier": F.coalesce(outside(col(c), f.low, f.high), F.lit(False)) for c, f in fences.items()})


def clean_stream(stream: DataFrame, plan: CleaningPlan) -> DataFrame:
    """The row-by-row steps of a fitted plan; duplicates are the business of ``dedup``."""
    return plan.finish_cells(plan.rewrite_cells(stream))


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Process all that is there now, write it to the shared folder and read it back."""
    spark: SparkSession = stream.sparkSession
    path = scratch_path(spark, name)
    query: StreamingQuery = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{path}/_state").start(f"{path}/rows"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
