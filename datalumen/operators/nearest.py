"""Nearest vectors by cosine: exactly, or through an index of centroid buckets with several probes.

Both ways score every candidate by its whole vector. The exact way lets the queries face all rows; the index lets each query
face the buckets of its nearest centres. Buckets above ``SLICE_ROWS`` rows are dealt to several slices, so one full of copies
is no single task. Queries and rows meet by a shuffle and no query passes through the driver; what the driver holds of the index are its
centres, fitted on at most ``sample`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.operators.facing import Best, dealt, faced, spread, top
from datalumen.session import scratch_path

SLICE_ROWS, CELLS = 500_000, 4_000_000
SAMPLE, ROUNDS = 20_000, 12


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column, of which all have the same size, as unit rows."""
    return unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


class Near:
    """One block of query vectors over one slice of rows."""

    def __init__(self, k: int):
        self.k, self.asked, self.held = k, [], None

    def ask(self, queries: pa.RecordBatch) -> None:
        self.asked.append((queries.column("id").to_numpy(), matrix(queries.column("v"))))

    def read(self, rows: pa.RecordBatch) -> None:
        if not self.asked:
            return
        if self.held is None:
            self.ids, self.target = (np.concatenate(x) for x in zip(*self.asked))
            self.held = Best(len(self.ids), self.k)
        ids, data = rows.column("id").to_numpy(), matrix(rows.column("v"))
        step = max(1, CELLS // len(self.ids))
        for low in range(0, len(ids), step):
            score = data[low:low + step] @ self.target.T
            row, query = np.nonzero(score > self.held.bar - 1e-5)
            self.held.add(query, ids[low + row], score[row, query])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.held is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return self.ids[self.held.query], self.held.row, self.held.score


def exact(asked: DataFrame, queries: int, rows: DataFrame, most: int, k: int, block: int) -> DataFrame:
    """The k nearest of all rows (``id, v``; at most ``most``) for each of so many queries (``id, v``)."""
    spark = rows.sparkSession
    blocks = max(1, math.ceil(queries / block))
    slices = max(math.ceil(most / SLICE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("_slice", spread(F.lit(slices)))
    held = rows.withColumn("_slice", F.pmod(F.xxhash64("id", "v"), F.lit(slices)).cast("int")).withColumn("_block", spread(F.lit(blocks)))
    keys = ["_slice", "_block"] if blocks > 1 else ["_slice"]
    both = dealt(asked.select("id", "v", *keys), held.select("id", "v", *keys), keys, slices * blocks)
    return top(faced(both, keys, lambda: Near(k)), k)


def centres(sample: np.ndarray, buckets: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of unit vectors by spherical k-means; copies in the sample count once at the start."""
    distinct = np.unique(np.round(sample, 6), axis=0)
    start = np.random.default_rng(7).permutation(len(distinct))[:max(1, buckets)]
    found = unit(distinct[start])
    for _ in range(rounds):
        near = np.argmax(sample @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        some = np.bincount(near, minlength=len(found)) > 0
        found[some] = unit(sums[some])
    return found


@dataclass
class VectorIndex:
    """All rows (``id, v, bucket``) under their nearest centre, and the rows of each bucket."""

    centres: np.ndarray
    rows: DataFrame
    sizes: DataFrame

    def probed(self, asked: DataFrame, probes: int) -> DataFrame:
        """``id, v, bucket``: each query under its nearest centres."""
        return _placed(asked, self.centres, probes)

    def search(self, asked: DataFrame, k: int, probes: int) -> DataFrame:
        """The k nearest rows that the probed buckets hold, for each query."""
        spark = self.rows.sparkSession
        slices = F.ceil(F.col("n") / SLICE_ROWS)
        # One row for each centre.
        sizes = F.broadcast(self.sizes)
        near = self.probed(asked, probes).join(sizes, "bucket").withColumn("_slice", spread(slices)).drop("n")
        some = near.select(F.col("bucket").alias("bucket")).distinct()
        held = self.rows.join(F.broadcast(some), "bucket", "left_semi").join(sizes, "bucket")
        held = held.withColumn("_slice", F.pmod(F.xxhash64("id", "v"), slices).cast("int")).drop("n")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return top(faced(dealt(near, held, ["bucket", "_slice"], parts), ["bucket", "_slice"], lambda: Near(k)), k)


def _placed(rows: DataFrame, found: np.ndarray, probes: int) -> DataFrame:
    known = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = matrix(batch.column("v")) @ known.value.T
            n = min(probes, score.shape[1])
            near = np.argpartition(-score, n - 1, axis=1)[:, :n].ravel() if n > 1 else np.argmax(score, axis=1)
            at = pa.array(np.repeat(np.arange(batch.num_rows), n))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), pa.array(near.astype(np.int32))], names=["id", "v", "bucket"])

    return rows.select("id", "v").mapInArrow(run, "id bigint, v array<double>, bucket int")


def build_index(rows: DataFrame, buckets: int | None = None, sample: int = SAMPLE, path: str | None = None) -> VectorIndex:
    """Index every row (``id, v``), written to ``path`` or the shared folder.

    Centres are fitted on the ``sample`` rows with the smallest hashes. Without ``buckets`` there are about as many as the root of
    the number of rows, at most one for 16 rows of the sample.
    """
    spark = rows.sparkSession
    if buckets is None:
        buckets = max(1, min(math.isqrt(rows.count()), sample // 16))
    taken = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).select("v").toArrow().combine_chunks()
    data = matrix(taken["v"].combine_chunks()) if taken.num_rows else np.zeros((1, 1))
    found = centres(data, min(buckets, len(data)))
    path = path or scratch_path(spark, "vectors")
    _placed(rows, found, 1).write.parquet(path)
    held = spark.read.parquet(path)
    sizes = held.groupBy("bucket").agg(F.count("*").alias("n"))
    return VectorIndex(found, held, sizes)
