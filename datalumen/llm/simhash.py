"""Near copies by SimHash: fingerprints that share blocks are joined and compared by Hamming distance.

A fingerprint of 64 bits has four blocks of 16 bits. Two fingerprints that differ in at most two bits agree in at
least two blocks, so each fingerprint is filed under its six pairs of blocks and only fingerprints in one file are
compared. Equal fingerprints are one class from the start, so exact copies are never paired.

A file may hold thousands of fingerprints (variants of one text). Files above ``SMALL_FILE`` are not paired but
linked through midpoints: within a file only 32 bits can differ, and two fingerprints differ in at most two of them
exactly when they have a common neighbour at distance at most one. Each is listed under itself and its 32
neighbours; those in one list, 33 at most, are all within two bits of each other and become a star. That loses no link
of the components and grows linearly with the file.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows share their class. A row
without an id gets the smallest id that it reaches, or null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.llm.common import documents, key, slices, unused
from datalumen.llm.components import components
from datalumen.session import checkpointed

SHINGLE = 3
DISTANCE = 2
SMALL_FILE = 16
_BLOCK, _BLOCKS, _CHUNK = 16, 4, 1 << 16
_LAST = 2**63 - 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text; a bit is set if over half of the shingle hashes have it."""
    words = text.lower().split()  # of bytes: only A-Z change, only ASCII white space separates
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        bits = np.unpackbits(hashes[at:at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, row_key, bits``: the fingerprint of every row as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            found = np.array([fingerprint(texts.raw(i), shingle) for i in range(len(texts))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [texts.rows.column("doc_id"), texts.rows.column("row_key"), pa.array(found.view(np.int64))],
                names=["doc_id", "row_key", "bits"])

    return key(documents(docs)).mapInArrow(run, "doc_id bigint, row_key bigint, bits bigint")


def links(classes: DataFrame, small: int = SMALL_FILE) -> DataFrame:
    """``u, v``: links between nodes ``(doc, bits)`` that connect exactly what lies within two bits."""
    files = []
    for k, (i, j) in enumerate(combinations(range(_BLOCKS), 2)):
        mask = sum(((1 << _BLOCK) - 1) << (_BLOCK * b) for b in (i, j))
        signed = mask - 2**64 if mask >= 2**63 else mask
        files.append(F.struct(F.lit(k).alias("pair"), F.col("node.bits").bitwiseAND(F.lit(signed)).alias("part")))
    filed = classes.select("node", F.explode(F.array(*files)).alias("file"))
    counts = checkpointed(filed.groupBy("file").agg(F.count("*").alias("n")).where("n > 1"))
    shared = checkpointed(filed.join(counts, "file"))

    near = shared.where(F.col("n") <= small).select("file", "node")
    pairs = near.withColumnRenamed("node", "u").join(near.withColumnRenamed("node", "v"), "file")
    pairs = pairs.where("u > v").where(F.bit_count(F.expr("u.bits ^ v.bits")) <= DISTANCE).select("u", "v")

    free = [[b for x in range(_BLOCKS) if x not in ij for b in range(_BLOCK * x, _BLOCK * (x + 1))] for ij in combinations(range(_BLOCKS), 2)]
    flips = F.array(*[F.array(F.lit(0).cast("bigint"), *[F.lit((1 << b) - (2**64 if b == 63 else 0)).cast("bigint") for b in bits])
                      for bits in free])
    listed = shared.where(F.col("n") > small).select(
        "file", "node", F.explode(flips[F.col("file.pair")]).alias("flip")).select(
        "file", "node", F.expr("node.bits ^ flip").alias("point"))
    stars = listed.groupBy("file", "point").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") > 1)
    stars = stars.select(F.array_min("nodes").alias("v"), F.explode("nodes").alias("u")).where("u > v").select("u", "v")
    return pairs.union(stars).distinct()


def _rooted(docs: DataFrame, shingle: int, small: int) -> DataFrame:
    """``doc_id, row_key, bits, root``: every row with the smallest node of its component."""
    rows = checkpointed(fingerprints(docs, shingle))
    classes = checkpointed(rows.groupBy("bits").agg(F.coalesce(F.min("doc_id"), F.lit(_LAST)).alias("doc")).select(
        F.struct("doc", "bits").alias("node")))
    roots = components(links(classes, small)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    labels = checkpointed(classes.join(roots, "node", "left").select(
        F.col("node.bits").alias("bits"), F.coalesce("root", "node").alias("root")))
    return rows.join(labels, "bits")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, small: int = SMALL_FILE) -> DataFrame:
    """``doc_id, bits, component_id`` of every row."""
    return _rooted(docs, shingle, small).select(
        "doc_id", "bits", F.when(F.col("root.doc") != _LAST, F.col("root.doc")).alias("component_id"))


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, small: int = SMALL_FILE) -> DataFrame:
    """The documents, all columns, with one row of each component: one with the smallest id, rows without id last."""
    rows = checkpointed(_rooted(docs, shingle, small).select("doc_id", "row_key", "root"))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)), "row_key")).alias("first")
    chosen = rows.groupBy("root").agg(first).select(F.col("first.row_key").alias("row_key"))
    kept = checkpointed(rows.groupBy("row_key").agg(F.count("*").alias("n")).join(chosen, "row_key"))
    name = unused(docs, "row_key")
    keyed = docs.withColumn(name, F.xxhash64(docs["doc_id"].cast("bigint"), docs["text"].cast("string")))
    once = keyed.join(kept.where("n = 1").select(F.col("row_key").alias(name)), name, "left_semi")
    again = kept.where("n > 1")
    if not again.isEmpty():
        once = once.union(keyed.join(again.select(F.col("row_key").alias(name)), name, "left_semi").dropDuplicates([name]))
    return once.select(*[once[c] for c in docs.columns])
