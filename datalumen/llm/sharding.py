"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered in the order of ``doc_id`` (ties by checksum and size). A balanced Feistel network permutes the next power of
four; numbers that fall outside are permuted again until they are inside (cycle walking), so the rows are permuted among themselves.
Place ``p`` lies in shard ``p mod shards`` at slot ``p div shards``, so shards differ by at most one row and have no gaps,
and both directions can be computed without looking at the data.

Null texts have size 1; rows without an id come first. Repeated rows get places of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.llm.common import documents, mixed
from datalumen.session import checkpointed

SHARDS, SEED, ROUNDS = 16, 42, 6


class Permutation:
    """A permutation of ``0 … n - 1`` and its inverse."""

    def __init__(self, n: int, seed: int = SEED):
        self.n = n
        self.half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed % 2**32) * np.uint64(1 << 32))

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & self.mask)
        return right << self.half | left  # halves swapped, so that the reversed keys undo it

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._once(x.astype(np.uint64), keys)
        while (outside := out >= self.n).any():
            out[outside] = self._once(out[outside], keys)
        return out.astype(np.int64)

    def place(self, row: np.ndarray) -> np.ndarray:
        return self._walk(row, self.keys)

    def row(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, self.keys[::-1])


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, dict[int, int]]:
    """The rows in order, written down with ``_at`` (part and place in it), and the rows before each part."""
    tie = F.monotonically_increasing_id()  # splits runs of equal rows, whose order does not matter
    placed = rows.withColumn("_tie", tie).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    placed = checkpointed(placed.withColumn("_at", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for r in counts:
        before[r["part"]], total = total, total + r["n"]
    return placed, before | {-1: total}


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, row, shard, slot`` of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = documents(docs).select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed, before = numbered(rows, "doc_id", "text_crc32", "size")
    permutation = Permutation(before.pop(-1), seed)
    parts = np.array(list(before), dtype=np.int64)
    starts = np.array(list(before.values()), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_at").to_numpy()
            row = starts[np.searchsorted(parts, at >> 33)] + (at & ((1 << 33) - 1))
            place = permutation.place(row)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "size", "text_crc32")], pa.array(row), pa.array((place % shards).astype(np.int32)),
                                              pa.array(place // shards)], names=["doc_id", "size", "text_crc32", "row", "shard", "slot"])

    return placed.mapInArrow(run, "doc_id bigint, size bigint, text_crc32 bigint, row bigint, shard int, slot bigint")
