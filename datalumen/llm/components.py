"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``u, v``: every linked node with the smallest node of its component, from links ``u, v`` of any orderable type.

    Each round joins the links to one minimum per node, so no task holds the links of one node; a node with very
    many links is split by the skewed join. The smallest nodes themselves are not returned. Rounds grow with the
    logarithm of the longest chain.
    """
    edges = checkpointed(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges
        seen = state
        # large star: every larger neighbour moves to the smallest neighbour
        both = edges.union(edges.select("v", "u"))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        edges = checkpointed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours move to the smallest of them
        least = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m")))
        moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
