"""The business domain of each table of a catalogue, from its column names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.functions import fixed


def table_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: its name, its rows and its column names."""
    parts = [
        df.agg(F.count("*").alias("num_rows")).select(
            F.lit(name).alias("table"), "num_rows",
            F.array(*[F.lit(c.lower().replace(" ", "_")) for c in df.columns]).alias("columns"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def classify_tables(catalog: DataFrame, keywords: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Domain, score, confidence and runner-up per table.

    A keyword counts once per table if any column name holds it. The keyword list is a constant of the
    plan, so tables and keywords meet inside the row and no join is needed.
    """
    keywords = keywords or fixed.DOMAIN_KEYWORDS
    scores = []
    for place, (domain, words) in enumerate(keywords.items()):
        listed = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(n).alias("weight")) for w, n in words.items()])
        held = F.filter(listed, lambda k: F.exists("columns", lambda c: c.contains(k["word"])))
        score = F.aggregate(held, F.lit(0), lambda acc, k: acc + k["weight"])
        scores.append(F.struct((-score).alias("order"), F.lit(place).alias("place"), F.lit(domain).alias("domain")))
    ranked = catalog.withColumn("_ranked", F.array_sort(F.array(*scores)))
    score = -F.col("_ranked")[0]["order"]
    confidence = F.lit("Unknown")
    for least, name in reversed(fixed.CONFIDENCE_LEVELS):
        confidence = F.when(score >= least, name).otherwise(confidence)
    known = score >= fixed.CONFIDENCE_LEVELS[-1][0]
    return ranked.select(
        "table", "num_rows", F.when(known, F.col("_ranked")[0]["domain"]).otherwise(fixed.GENERAL_DOMAIN).alias("domain"),
        confidence.alias("confidence"), score.cast("bigint").alias("score"), F.col("_ranked")[1]["domain"].alias("runner_up"))
