"""Tables to files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, **options) -> str:
    """Write a folder of files, one per task; CSV gets a header."""
    writer = df.write.mode("overwrite").format(fmt).options(**({"header": True} if fmt == "csv" else {}), **options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path
